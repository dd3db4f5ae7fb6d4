import random
import uuid

import pytest
from pyspark.sql import functions as F

from idloom.functions import columns
from idloom.operators import identifiers as ids

TAIL = "7a1d2f34-5678-49ab-9012-abcdef123456"
VALID = ["gts.a.b.c.d.v1~", "gts.a.b.c.d.v0~", "gts.a.b.c.d.v1~e.f.g.h.v1.0", "gts.a.b._.d.v1~", f"gts.a.b.c.d.v1~{TAIL}", "gts.~a.b.c.d.v1~", "gts.*", "gts.a.b.c.d.v1~*", "gts.1bad.*", "gts.a.b.c.d.v1.*", "gts.a.b.c.d.v1~ e.f.g.h.v1 "]
INVALID = ["gts.a.b.c.d.v1.0", "gts.a.b.c.d.v01~", "gts.a.b.c.d.v1.00~", "gts.a.b.c.d.1~", "GTS.a.b.c.d.v1~", "gts.", "gts.~", "gts..a.b.c.d.v1~", "gts.a.b.c.d.v1~~", "gts.a-b.c.d.e.v1~", f"gts.{TAIL}", "gts.a.b.c.d.v1.2.3~", "gts.a*", "gts.a.*.b", "gts.a.*~", "gts.*.*", "gts.a.b.c.d.vx.*", "gts.a.b.c.d.v1.2.*", "", "x", "gts.a", "gts.a.b.c.d.v1~\n~", "gts.a.b.c.d.v9007199254740993~", "gts." + "a" * 1021, "gts.a.b.C.d.v1~", "gts.é.b.c.d.v1~"]


def dirty(n=1500):
    r = random.Random(7)
    bits = ["gts", ".", ".", "~", "a", "b_1", "v1", "v0", "v01", "1", "-", "*", " ", "A", "..", " ", TAIL, ".c.d.v1~", "gts.a.b.c.d.v1", "gts.x.y.z.t.v2.3~", "é", "\n"]
    return ["".join(r.choices(bits, k=r.randrange(1, 9))) for _ in range(n)] + ["gts." + "".join(r.choices(bits, k=r.randrange(1, 7))) for _ in range(n)]


def test_truth_table():
    assert all(ids.is_valid(x) for x in VALID) and not any(ids.is_valid(x) for x in INVALID)
    assert ids.error(" gts.a.b.c.d.v1~") is None and not ids.is_valid(" gts.a.b.c.d.v1~")
    assert ids.error("gts.a.b.c.d.v1.0") == "Invalid GTS identifier: gts.a.b.c.d.v1.0: " + ids.SINGLE
    assert ids.error("gts.a.b.c.d.x1~") == "Invalid GTS segment #1 @ offset 4: 'a.b.c.d.x1~': Major version must start with 'v'"


@pytest.mark.parametrize(
    ("candidate", "pattern", "want"),
    [
        ("gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v1~", True),
        ("gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v1.5~", True),
        ("gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v1.4~", False),
        ("gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v1~x.*", True),
        ("gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v0.*", True),
        ("gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v2.*", False),
        ("gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v1~x.y.z.w.v2", True),
        ("gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v1~x.y.z.w.v2~", False),
        ("gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v1.5", False),
        ("gts.a.b.c.d.v1~", "gts.a.b.c.d.v1~*", False),
        (f"gts.a.b.c.d.v1~{TAIL}", "gts.a.b.c.d.v1~*", True),
        (f"gts.a.b.c.d.v1~{TAIL}", "gts.a.b.c.d.v1~x.*", False),
    ],
)
def test_matching(candidate, pattern, want):
    assert ids.match(candidate, pattern) == (want, None)


def test_columns_agree_with_python(spark):
    texts = VALID + INVALID + dirty()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", columns.error(F.col("t")).alias("e"), columns.error(F.col("t"), True).alias("p"), columns.is_valid(F.col("t")).alias("v"), columns.parsed(F.col("t")).alias("s"), columns.id_uuid(F.col("t")).alias("u")).collect()
    for r in rows:
        t = texts[r.i]
        assert (r.e, r.p, r.v) == (ids.error(t), ids.error(t, True), ids.is_valid(t)), repr(t)
        if r.e is None:
            assert [x.asDict() for x in r.s.segments] == [ids.record(x) for x in ids.parse(t)], repr(t)
            assert r.u.uuid == str(uuid.uuid5(ids.NAMESPACE, t))
        else:
            assert r.s.segments == [] and r.u.uuid == ""


def test_matching_columns_agree_with_python(spark):
    r = random.Random(3)
    some = [t for t in VALID + dirty(400) if ids.error(t, True) is None] + INVALID[:6] + ["gts.a.b.c.d.v1.5~x.y.z.w.v2.0", "gts.a.b.c.d.v1.*"]
    pairs = [(r.choice(some), r.choice(some)) for _ in range(1500)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, c string, p string")
    for row in df.select("i", columns.matches(F.col("c"), F.col("p")).alias("m")).collect():
        assert (row.m.match, row.m.error) == ids.match(*pairs[row.i]), pairs[row.i]


def test_uuid_anchor():
    assert ids.to_uuid("gts.vendor.pkg.ns.type.v1~") == "df02d694-fa79-50a2-818f-72d4915e4854"


def test_null(spark):
    row = spark.sql("select cast(null as string) t").select(columns.error(F.col("t")).alias("e"), columns.is_valid(F.col("t")).alias("v")).first()
    assert row.e is None and row.v is False
