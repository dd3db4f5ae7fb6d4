import json

import pytest
from pyspark.sql import functions as F

from idloom.functions import columns
from idloom.operators import extraction
from idloom.plans import query as q
from idloom.sources import json_directory

BASE, CHAIN = "gts.a.b.c.d.v1~", "gts.a.b.c.d.v1~e.f.g.h.v1.0"
DOCS = [
    {"gtsId": "gts.a.b.c.d.v1.0", "name": "x"},
    {"$$id": BASE, "$$schema": "http://json-schema.org/draft-07/schema#", "type": "object"},
    {"$id": f"gts://{BASE}", "$schema": "http://json-schema.org/draft-07/schema#"},
    {"$id": BASE, "type": "object"},
    {"$id": BASE, "$schema": f"gts://{BASE}"},
    {"gtsId": CHAIN, "data": 1},
    {"gtsId": CHAIN, "$schema": BASE},
    {"$id": f"{BASE}e.f.g.h.v1~", "$schema": f"gts://{BASE}"},
    {"$id": CHAIN},
    {"id": " plain ", "type": BASE},
    {"id": 7, "gts_id": "", "gts_iid": " gts://x ", "schema": "nope"},
    {"$schema": 5, "$$schema": BASE, "id": "i"},
    {"$schema": "", "$$schema": BASE, "id": "i"},
    {"$schema": 0, "$$schema": BASE, "id": "i"},
    {"id": f"{BASE}e.f.g.h.v1~", "gtsTid": BASE},
    [], "text", None, {},
]


def test_extraction_columns_agree_with_python(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "i int, c string")
    rows = {r.i: r.x for r in df.select("i", extraction.extracted(F.col("c")).alias("x")).collect()}
    for i, d in enumerate(DOCS):
        assert (rows[i].id, rows[i].schema_id, rows[i].is_schema) == extraction.extract(d), d
    assert rows[5].schema_id == BASE and rows[7].schema_id == BASE and not rows[3].is_schema and rows[4].is_schema
    assert (rows[9].selected_entity_field, rows[9].selected_schema_id_field) == ("id", "type")


def test_js_string(spark):
    values = [1, 1.0, 1.5, 100.0, -2, True, False, None, "a", [1, None, "b", [2, 3]], {"k": 1}, 1e21, 0.001, 12345678.25]
    want = ["1", "1", "1.5", "100", "-2", "true", "false", "", "a", "1,,b,2,3", "[object Object]", "1e+21", "0.001", "12345678.25"]
    df = spark.createDataFrame([(i, json.dumps({"k": v})) for i, v in enumerate(values)], "i int, c string")
    got = {r.i: r.s for r in df.select("i", extraction.js_string(extraction.field(extraction.variant(F.col("c")), "k")).alias("s")).collect()}
    assert [got[i] for i in range(len(values))] == want


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("gts.a.*", None),
        ("gts.a.*[k=v", q.NO_BRACKET),
        (f"{BASE}[k=v]", q.TYPE_FILTER),
        ("gts.a*", q.STAR),
        ("x.*", q.START),
        ("gts.a.b.c.d.v1~e.f.g.h.v0", q.INCOMPLETE),
        ("gts.a.b.c.d.v1~7a1d2f34-5678-49ab-9012-abcdef123456", q.INCOMPLETE),
        ("gts.a.* OR gts.b.*", None),
        ("nope", "Invalid query: Invalid GTS identifier: nope: Does not start with 'gts.'"),
    ],
)
def test_query_errors(text, error):
    assert q.parse_query(text).error == error


def test_query_filters():
    assert q.parse_query("gts.a.*[ k = \"v\" , x='y=z', drop, k=2]").filters == {"k": "2", "x": "y=z"}


def test_conditions(spark):
    rows = [("gts.a.b.c.d.v1~e.f.g.h.v1.0", '{"k":"v","n":1.0}'), ("gts.a.b.c.d.v1~e.f.g.h.v1.1", '{"k":null}'), ("gts.z.b.c.d.v1~e.f.g.h.v1.0", '{"k":"v"}'), ("bad", '{"k":"v"}')]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("s", F.when(columns.error(F.col("id")).isNull(), columns.segments(F.col("id"))))
    run = lambda text: [r.id for r in df.filter(q.condition(q.parse_query(text), F.col("s"), F.col("content"))).collect()]
    assert run("gts.a.*") == [rows[0][0], rows[1][0]]
    assert run("gts.a.*[k=v]") == [rows[0][0]] == run("gts.*[k=*,n=1]") and run("gts.a.*[k=]") == [rows[1][0]]
    assert run("gts.a.* OR gts.z.*") == []


def test_directory(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "one", "x": [1, 2]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "two"}, {"name": "no id"}, {"id": "three"}]))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.txt").write_text("{}")
    got = json_directory.read_documents(spark, f"{tmp_path},{tmp_path}/missing").collect()
    assert sorted(json.loads(r.content)["id"] for r in got) == ["one", "three", "two"]
    assert json_directory.read_documents(spark, str(tmp_path), need_id=False).count() == 4
    assert [r.file.endswith("c.json") for r in json_directory.rejected(spark, str(tmp_path)).collect()] == [True]
    assert json_directory.read_documents(spark, f"{tmp_path}/missing").count() == 0
