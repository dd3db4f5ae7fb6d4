"""Where intermediate tables go, and that they go in the end."""

import os
from types import SimpleNamespace

import pytest

from idloom.operators import tables


def session(master, named=None):
    get = lambda key, default=None: named
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=get), getCheckpointDir=lambda: None, master=master, applicationId="app-1")
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(session(master))
    assert tables.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y/idloom-app-1"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_session_has_one_of_its_own(master):
    assert tables.shared_dir(session(master)).endswith("/idloom-app-1")


def test_tables_of_parts_and_by_column(spark):
    parts = (spark.range(i, i + 2).selectExpr("id", "id % 2 AS b") for i in (0, 2, 4))
    every = tables.written_all(parts)
    assert sorted(r.id for r in every.collect()) == list(range(6)) and len(every.inputFiles()) >= 3
    dealt = tables.written(every.selectExpr("id", "CAST(b AS INT) AS b").repartition("b"), "b")
    assert sorted(tuple(r) for r in dealt.filter("b = 1").select("id", "b").collect()) == [(1, 1), (3, 1), (5, 1)]
    folder = tables.shared_dir(spark)
    assert os.listdir(folder.removeprefix("file:"))
