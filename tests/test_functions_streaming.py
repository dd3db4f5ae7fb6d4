import json

from idloom.functions import sql
from idloom.operators.registry import Registry
from idloom.streaming import ingest

BASE = "gts.a.b.c.d.v1~"


def test_sql_functions(spark):
    assert len(sql.register_all(spark)) == 7
    r = spark.sql(f"""SELECT id_is_valid('{BASE}') v, id_is_valid(cast(null as string)) n, id_error('x') e, id_uuid('{BASE}') u, id_is_type('{BASE}') t, id_match('{BASE}x.y.z.t.v1', 'gts.a.*') m,
      id_parse('{BASE}')[0].vendor p, doc_attribute('{{"a":[1,{{"b":"c"}}]}}', 'a[1].b') a""").first()
    assert (r.v, r.n, r.t, r.m, r.p, r.a) == (True, None, True, True, "a", '"c"') and r.e.startswith("Invalid GTS identifier: x") and len(r.u) == 36


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    docs = [{"gtsId": f"{BASE}x.y.z.t.v1.{i % 2}", "n": i} for i in range(4)] + [{"name": "none"}]
    stream = ingest.read_stream(spark, str(source))
    schemas = Registry.of(spark.createDataFrame([(0, json.dumps({"$id": f"gts://{BASE}", "$schema": "http://json-schema.org/draft-07/schema#"}))], "seq long, content string")).entities
    q1 = ingest.latest(stream, "at").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q2 = ingest.checked(stream, schemas).writeStream.format("memory").queryName("checked").start()
    (source / "a.json").write_text("\n".join(map(json.dumps, docs)))
    q1.processAllAvailable()
    q2.processAllAvailable()
    assert {r.id for r in spark.table("latest").collect()} == {f"{BASE}x.y.z.t.v1.0", f"{BASE}x.y.z.t.v1.1"}
    assert sorted(r.schema_known for r in spark.table("checked").collect()) == [False, True, True, True, True]
    q1.stop()
    q2.stop()
