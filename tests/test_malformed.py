"""No document ends a job: document logic on random schemas of any kind, deep documents, and failures as rows."""

import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from idloom.operators import casting, compatibility, documents, inheritance
from idloom.operators.documents import Entity
from idloom.operators.jsonschema import less
from idloom.operators.registry import Registry, load
from idloom.operators.tables import CALLS, per_row

BASE, OTHER = "gts.a.b.c.d.v1.0~", "gts.a.b.c.d.v1.1~"
CHILD = f"{BASE}e.f.g.h.v1~"
KEYS = ["type", "properties", "required", "enum", "const", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "pattern", "items", "allOf", "anyOf", "oneOf", "not", "if", "then", "additionalProperties", "default", "x-gts-ref", "x-gts-traits", "x-gts-traits-schema", "$$ref", "$ref", "dependencies", "patternProperties", "contains", "multipleOf", "uniqueItems"]


def value(r, depth=0):
    plain = [None, True, False, 0, 1, 5, -2.5, "", "3", "a", "string", "object", "array", "integer", "(", BASE, f"gts://{BASE}", f"gts://{CHILD}", "/$id", ["string", "null"], ["a", 1, None], [], {}]
    if depth > 3 or r.random() < 0.4:
        return r.choice(plain)
    if r.random() < 0.2:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {k: value(r, depth + 1) for k in r.sample([*KEYS, "p", "q"], r.randrange(1, 7))}


def a_schema(r):
    v = value(r)
    out = v if isinstance(v, dict) else {"properties": v}
    if r.random() < 0.7:
        out["properties"] = {k: value(r, 2) for k in r.sample("pqr", 2)}
    return out


def test_no_schema_raises():
    sys.setrecursionlimit(CALLS)  # as in the tasks
    r = random.Random(4)
    for _ in range(4000):
        docs = {BASE: a_schema(r), OTHER: a_schema(r), CHILD: a_schema(r) | {"allOf": [{"$$ref": f"gts://{BASE}"}, value(r, 1)]}}
        own = {i: Entity(i, "x", True, d, json.dumps(d)) for i, d in docs.items()}
        item = {"gtsId": f"{BASE}x.y.z.t.v1", **{k: value(r, 2) for k in "pqr"}}
        own["item"] = own[item["gtsId"]] = Entity(item["gtsId"], BASE, False, item, json.dumps(item))
        find = own.get
        for e in (own[CHILD], own[BASE], None):
            assert isinstance(inheritance.schema_error(CHILD, e, find), str | None)
            assert isinstance(inheritance.entity_traits_error(CHILD, e, find), str | None)
        for flavor in compatibility.FLAVORS:
            assert set(compatibility.check(BASE, OTHER, find, flavor)) >= {"old", "backward_errors"}
            assert "ok" in casting.FLAVORS[flavor](item["gtsId"], OTHER, find)
        documents.schema_lint(docs[BASE])
        documents.schema_ref_errors(docs[BASE])


@pytest.mark.parametrize(("a", "b", "want"), [(5, "6", True), ("6", 5, False), (None, 1, True), ("10", "9", True), ({}, 1, False), ("x", 1, False), ("", 1, True), ([3], 4, True), (True, 2, True), (float("nan"), 1, False)])
def test_comparison_of_mixed_kinds(a, b, want):
    assert less(a, b) is want


def test_deep_documents(spark):
    deep = "[" * 900 + '"gts.x.y.z.t.v1~"' + "]" * 900
    text = f'{{"gtsId":"{BASE}a.b.c.d.v1","x":{deep}}}'
    assert documents.mentioned_ids(json.loads(text))[-1][1] == "gts.x.y.z.t.v1~"
    nested = '{"$$ref":"gts://gts.x.y.z.t.v1~","x":' * 4000 + "1" + "}" * 4000
    assert isinstance(documents.declared_references(load(nested)), list)
    r = Registry.of(spark.createDataFrame([(1, text), (2, nested), (3, '{"gtsId":"gts.x.y.z.t.v1~"}')], "seq long, content string"))
    assert ("gts.x.y.z.t.v1~", 2) in {(x.ref, x.n) for x in r.mentions().groupBy("ref").agg(F.count("*").alias("n")).collect()}
    assert r.graph(spark.createDataFrame([(f"{BASE}a.b.c.d.v1",)], "id string")).count() == 1


def test_failures_are_rows(spark):
    def fails(row):
        return [{"id": row["id"], "n": 1 // row["id"]}]

    rows = spark.range(3)
    assert sorted((r.id, r.n, r.e) for r in per_row(rows, lambda row: [x | {"e": ""} for x in fails(row)], "id long, n long, e string", lambda row, e: {"id": row["id"], "n": -1, "e": e}).collect()) == [(0, -1, "ZeroDivisionError: integer division or modulo by zero"), (1, 1, ""), (2, 0, "")]


def test_odd_texts(spark):
    docs = ['{"gtsId":"gts.x.y.z.t.v1~","half":"\\ud800 x","list":[1]}', '{"gtsId":"gts.x.y.z.t.v2~","half":5,"big":' + "9" * 5000 + "}"]
    r = Registry.of(spark.createDataFrame(list(enumerate(docs)), "seq long, content string"))
    asked = spark.createDataFrame([("gts.x.y.z.t.v1~", p) for p in ("half", "list[\u00b2]", "list.\u00b2", "list[0]")], "id string, path string")
    got = {x.path: (x.resolved, x.value) for x in r.attributes(asked).collect()}
    assert got == {"half": (True, '"\ufffd x"'), "list[\u00b2]": (False, None), "list.\u00b2": (False, None), "list[0]": (True, "1")}
