"""Registered queries over hand-written documents: for each rule that the table-derived documents of module queries don't reach, a few
documents by the key of a row, and SQL that states the outcome. § stands for the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions import columns
from idloom.operators.registry import Registry, ingested
from idloom.plans import queries as q
from idloom.plans.query import parse_query
from idloom.plans.queries import META, ORDER_TYPE, S, query, table

KEY = "p_partkey"


def cases(texts: list[str | None], plus: int = 0) -> str:
    """SQL text: of the texts the one that a row's key falls on."""
    one = lambda t: "CAST(NULL AS STRING)" if t is None else "'{}'".format(t.replace("'", "''")) if "§" not in t else "replace('{}', '§', {})".format(t.replace("'", "''"), S(KEY))
    return f"CASE CAST({KEY} % {len(texts)} AS INT) " + " ".join(f"WHEN {i} THEN {one(t)}" for i, t in enumerate(texts)) + " END"


def registry(spark: SparkSession, sf_dir: str, *docs: list[str | None]) -> Registry:
    """A registry of all documents of each row, in order; None: no document."""
    parts = table(spark, sf_dir, "part", KEY)
    every = F.array(*[F.expr(cases(d)) for d in docs])
    rows = parts.select(KEY, F.posexplode(every).alias("pos", "content")).filter("content is not null")
    return Registry.of(rows.select((F.col(KEY) * len(docs) + F.col("pos")).alias("seq"), "content"))


def wanted(spark: SparkSession, sf_dir: str, **made: list[str | None]) -> DataFrame:
    return table(spark, sf_dir, "part", KEY).select(*[F.expr(cases(t)).alias(n) for n, t in made.items()])


def schema(name: str, body: str) -> str:
    return f'{{"$$id":"{name}","$$schema":"{META}",{body}}}'


def props(body: str) -> str:
    return f'"type":"object","properties":{{{body}}}'


# --- identifiers and queries ---


@query(f"""
WITH d AS (SELECT o_orderkey, {q.DIRTY_ID} AS id FROM orders)
SELECT o_orderkey, ends_with(id, '~') AND NOT contains(id, '*') AS is_schema, contains(id, '*') AS is_wildcard, ends_with(id, '~') AS is_type,
  CASE o_orderkey % 18 WHEN 8 THEN 2 WHEN 9 THEN 2 WHEN 12 THEN 1 WHEN 13 THEN 1 WHEN 14 THEN 1 WHEN 16 THEN 2 ELSE 0 END AS n FROM d""")
def parse_flags(spark, sf_dir):
    found = q.orders(spark, sf_dir, id=q.DIRTY_ID).select("o_orderkey", "id", columns.parsed(F.col("id")).alias("p"))
    return found.select("o_orderkey", "p.is_schema", "p.is_wildcard", columns.is_type(F.col("id")).alias("is_type"), F.size("p.segments").alias("n"))


QUERIES = [
    ("gts.a.b.c.d.v1~x.*[k=v", "Invalid query: missing closing bracket ']'"),
    ("gts.a.b.c.d.v1~[k=v]", "Invalid query: filters cannot be used with type patterns (ending with ~ or ~*)"),
    ("gts.a.b*", "Invalid query: wildcard patterns must end with .* or ~*"),
    ("gtx.a.*", "Invalid query: pattern must start with 'gts.'"),
    ("gts.a.b.c.d.v1~x.y.z.t.v0", "Invalid query: incomplete GTS ID pattern"),
    ("gts.a.b", "Invalid query: Invalid GTS segment #1 @ offset 4: 'a.b': Too few tokens"),
    ("gts.a.b.c.d.v1~*", None),
    ("gts.a.b.c.d.v1~x.*[k=v, k2=\"w\"] ", None),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(a.replace("'", "''"), "NULL" if e is None else "'" + e.replace("'", "''") + "'") for a, e in QUERIES) + ") AS t(query, error)")
def query_errors(spark, sf_dir):
    return spark.createDataFrame([(text, parse_query(text).error) for text, _ in QUERIES], "query string, error string")


@query(f"SELECT {q.ORDER_ID} AS id, o_orderkey AS ord, {q.ORDER_DOC} AS content FROM orders WHERE o_orderstatus = 'F' AND o_custkey <> 7 OR o_orderstatus = 'P'")
def query_bool(spark, sf_dir):
    one = f"{ORDER_TYPE}x.tpch"
    return q.order_registry(spark, sf_dir).query_bool(lambda has: has(f"{one}.f.*") & ~has(f"{one}.*[cust=7]") | has(f"{one}.p.*"))


@query(f"SELECT {q.ORDER_ID} AS id, o_orderkey AS ord FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 12")
def query_ids(spark, sf_dir):
    return q.order_registry(spark, sf_dir).query_ids(f"{ORDER_TYPE}x.tpch.o.*", 12)


_AT = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN {0} || '@props.k' WHEN 1 THEN {0} || '@tags[7]' WHEN 2 THEN 'gts.no.such.thing.here.v1~@a@b' ELSE {0} END".format(q.EVENT_ID)


def _events(spark, sf_dir) -> tuple[Registry, DataFrame]:
    doc = f"""'{{"gtsId":"' || {q.EVENT_ID} || '","props":' || props || ',"tags":[0,' || {S('event_id')} || ']}}'"""
    rows = table(spark, sf_dir, "events", "event_id", "props")
    return Registry.of(rows.select("event_id", F.expr(doc).alias("content")), seq="event_id"), rows.select(F.expr(_AT).alias("at"))


@query(f"""
SELECT CASE WHEN event_id % 4 = 2 THEN 'gts.no.such.thing.here.v1~' WHEN event_id % 4 < 2 THEN {q.EVENT_ID} END AS id, CASE event_id % 4 WHEN 0 THEN 'props.k' WHEN 1 THEN 'tags[7]' WHEN 2 THEN 'a@b' ELSE {q.EVENT_ID} END AS path,
  event_id % 4 = 0 AS resolved, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k') END AS value,
  CASE event_id % 4 WHEN 2 THEN 'Entity not found: gts.no.such.thing.here.v1~' WHEN 3 THEN 'Invalid attribute path: missing @' END AS error FROM events""")
def attributes_at(spark, sf_dir):
    r, at = _events(spark, sf_dir)
    return r.attributes_at(at)


@query(f"""
SELECT CASE WHEN event_id % 4 = 2 THEN 'gts.no.such.thing.here.v1~@a@b' ELSE {q.EVENT_ID} END AS id, CASE event_id % 4 WHEN 0 THEN 'props.k' WHEN 1 THEN 'tags[7]' ELSE '' END AS path,
  event_id % 4 IN (0, 3) AS resolved, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 3 THEN '{{"gtsId":"' || {q.EVENT_ID} || '","props":' || replace(props, ' ', '') || ',"tags":[0,' || {S('event_id')} || ']}}' END AS value,
  CASE WHEN event_id % 4 = 2 THEN 'Entity not found: gts.no.such.thing.here.v1~@a@b' END AS error FROM events""")
def attributes_two_parts(spark, sf_dir):
    r, at = _events(spark, sf_dir)
    return r.attributes_at(at, strict=True)


# --- compatibility ---

LIBRARY = [  # old id, new id, old body, new body, direction, backward, forward
    ("gts.x.cmp.a.s§.v1.0~", "gts.x.cmp.a.s§.v1.1~", '"p":{"enum":["a","b"]}', '"p":{"enum":["a"]}', "upgrade", "Enum value 'b' removed from property 'p'", ""),
    ("gts.x.cmp.a.s§.v1.1~", "gts.x.cmp.a.s§.v1.0~", '"p":{"type":"integer"}', '"p":{"type":"number"}', "downgrade", "", "Property 'p' type incompatibly changed from integer to number"),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.t§.v1~", '"p":{"type":"string"},"q":{}', '"q":{}', "same", "Required property 'p' removed in new schema", ""),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '"p":{"type":["string","null"]}', '"p":{"type":"string"}', "upgrade", "Property 'p' type incompatibly changed from string|null to string", ""),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '"p":{"type":"object","properties":{"q":{"type":"string"}}}', '"p":{"type":"object","properties":{"q":{"type":"number"}}}', "upgrade", "", ""),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '"p":{"type":"string"}', '"p":{}', "upgrade", "", "Property 'p' type incompatibly changed from string to any"),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '"p":{"enum":5},"q":7', '"p":{"enum":["a"]},"q":[]', "upgrade", "", ""),
]


def _compared(spark, sf_dir, rows: list[tuple], flavor: str) -> DataFrame:
    wrap = lambda body: body[1:] if body.startswith("!") else '"required":["p"],' + props(body)
    r = registry(spark, sf_dir, [schema(x[0], wrap(x[2])) for x in rows], [None if x[3] is None else schema(x[1], wrap(x[3])) for x in rows])
    found = r.compatibility(wanted(spark, sf_dir, old=[x[0] for x in rows], new=[x[1] for x in rows]), flavor)
    return found.select("old", "new", "direction", F.array_join("backward_errors", "; ").alias("backward"), F.array_join("forward_errors", "; ").alias("forward"))


def _compared_sql(rows: list[tuple]) -> str:
    return f"SELECT {', '.join(f'{cases([x[i] for x in rows])} AS {n}' for i, n in ((0, 'old'), (1, 'new'), (4, 'direction'), (5, 'backward'), (6, 'forward')))} FROM part"


@query(_compared_sql(LIBRARY))
def compat_library_cases(spark, sf_dir):
    return _compared(spark, sf_dir, LIBRARY, "library")


REGISTRY = [
    ("gts.x.cmp.a.s§.v1.0~", "gts.x.cmp.a.s§.v1.1~", '"p":{"enum":["a"]}', '"p":{"enum":["a","b"]}', "up", "Property 'p' added enum values: b", ""),
    ("gts.x.cmp.a.s§.v1.1~", "gts.x.cmp.a.s§.v1.0~", '"p":{"enum":["a","b",1]}', '"p":{"enum":["a"]}', "down", "", "Property 'p' removed enum values: b, 1"),
    ("gts.x.cmp.a.s§.v1.0~", "gts.x.cmp.a.t§.v1.0~", '"p":{"type":"object","properties":{"q":{"type":"integer","minimum":1}}}', '"p":{"type":"object","properties":{"q":{"type":"integer","minimum":3}}}', "none", "Property 'p': Property 'q' minimum increased from 1 to 3", ""),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '"p":{"type":"array","items":{"properties":{"q":{"type":"string","minLength":5}}}}', '"p":{"type":"array","items":{"properties":{"q":{"type":"string"}}}}', "unknown", "", "Property 'p' array items: Property 'q' removed minLength constraint"),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '!"allOf":[{"properties":{"a":{"type":"string"}},"required":["a"]},{"properties":{"b":{}}}]', '!"properties":{"a":{"type":"integer"}}', "unknown", "Property 'a' type changed from string to integer", "Removed required properties: a; Property 'a' type changed from string to integer"),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '"p":{"type":"array","maxItems":5}', '"p":{"type":"array","maxItems":3,"minItems":1}', "unknown", "Property 'p' added minItems constraint: 1; Property 'p' maxItems decreased from 5 to 3", ""),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '"p":{"type":"string","maxLength":5,"enum":5}', '"p":{"type":"string","maxLength":"6","enum":["a"]}', "unknown", "", "Property 'p' maxLength increased from 5 to 6"),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '"p":{"type":"integer","minimum":null}', '"p":{"type":"integer","minimum":1}', "unknown", "Property 'p' minimum increased from null to 1", ""),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '!"properties":["a"],"required":"p"', '!"properties":["b"],"required":5', "unknown", "", ""),
    ("gts.x.cmp.a.s§.v1~", "gts.x.cmp.a.s§.v2~", '"p":{}', None, "unknown", "Schema not found", "Schema not found"),
]


@query(_compared_sql(REGISTRY))
def compat_registry_cases(spark, sf_dir):
    return _compared(spark, sf_dir, REGISTRY, "registry")


# --- inheritance ---

_B, _C = "gts.x.inh.a.b§.v1~", "gts.x.inh.a.b§.v1~x.inh.a.c.v1~"
INHERITED = [  # the base's p, the child's p, error; with ! whole bodies
    ('{"type":"string","maxLength":5}', '{"type":"string"}', "Property 'p' drops constraint 'maxLength'"),
    ('{"enum":["a"]}', '{"enum":["a","b"]}', "Property 'p' enum value 'b' not in base enum"),
    ('{"const":1}', '{"const":2}', "Property 'p' const conflict: 2 vs base 1"),
    ('{"pattern":"a"}', '{"pattern":"b"}', "Property 'p' pattern changed from 'a' to 'b'"),
    ('{"type":"string"}', "false", "Property 'p' is set to false but exists in base"),
    ("false", '{"type":"string"}', "Property 'p' is forbidden in base"),
    ('{"type":"string"}', '{"type":"integer"}', "Property 'p' type changed from 'string' to 'integer'"),
    ('{"type":"string"}', '{"type":["string","null"]}', "Property 'p' widens type from 'string' to array"),
    ('{"type":["string","null"]}', '{"type":"integer"}', "Property 'p' type 'integer' not in base types [string,null]"),
    ('{"type":["string","null"]}', '{"type":"string"}', ""),
    ('{"type":"object","properties":{"q":{"type":"integer","maximum":5}}}', '{"type":"object","properties":{"q":{"type":"integer","maximum":9}}}', "Property 'p.q' loosens 'maximum' from 5 to 9"),
    ('{"items":{"type":"string","maxLength":3}}', '{"items":{"type":"string","maxLength":4}}', "Property 'p.items' loosens 'maxLength' from 3 to 4"),
    ('{"maximum":5,"minimum":3}', '{"const":9,"minimum":2}', "Property 'p' loosens 'minimum' from 3 to 2; Property 'p' const 9 violates base maximum 5"),
    ('{"maxLength":5,"enum":5}', '{"maxLength":"6","enum":["a"]}', "Property 'p' loosens 'maxLength' from 5 to 6"),
    ('{"maximum":null,"minimum":"3"}', '{"const":1,"maximum":1,"minimum":"3"}', "Property 'p' loosens 'maximum' from null to 1; Property 'p' const 1 violates base minimum 3; Property 'p' const 1 violates base maximum null"),
    ('!"properties":["a"]', '!"properties":["b"]', ""),
    ('!"properties":{"p":{}},"additionalProperties":false', '!"properties":{"q":{}}', "Property 'q' not in base and base has additionalProperties: false; Base has additionalProperties: false but derived does not restate it"),
    ('!"properties":{},"additionalProperties":false', '!"additionalProperties":true', "Cannot loosen additionalProperties from false to true"),
    (f'!"allOf":[{{"$$ref":"gts://{_C}"}}]', '!"properties":{}', f"Cyclic reference detected: {_C}"),
    (None, '{"type":"string"}', f"Parent schema not found: {_B}"),
]


@query(f"SELECT {cases([_C])} AS id, {cases([x[2] for x in INHERITED])} AS error FROM part")
def schema_parents_cases(spark, sf_dir):
    body = lambda p: p[1:] if p.startswith("!") else f'"properties":{{"p":{p}}}'
    bases = [None if b is None else schema(_B, body(b)) for b, _, _ in INHERITED]
    children = [schema(_C, f'"allOf":[{{"$$ref":"gts://{_B}"}},{{{body(c)}}}]') for _, c, _ in INHERITED]
    return registry(spark, sf_dir, bases, children).validate_schemas(wanted(spark, sf_dir, id=[_C])).select("id", "error")


_T0 = "gts.x.trt.a.b§.v1~"
_T1 = _T0 + "x.trt.a.m.v1~"
_T2 = _T1 + "x.trt.a.l.v1~"
_COLOR = '"x-gts-traits-schema":{"type":"object","properties":{"color":{"type":"string"%s}}}'
TRAITS = [  # bodies of the base, the middle and the leaf; error of the leaf
    (_COLOR % "", '"x-gts-traits":{"color":"red"}', '"x-gts-traits":{"color":"blue"}', f"trait 'color' in '{_T2}' overrides value set by ancestor"),
    (_COLOR % ',"default":"red"', _COLOR % ',"default":"blue"', '"title":"leaf"', f"trait schema default for 'color' in '{_T1}' overrides default set by ancestor"),
    (_COLOR % ',"default":"red"', '"title":"m"', '"title":"leaf"', ""),
    (_COLOR % "", '"title":"m"', '"title":"leaf"', "trait property 'color' is not resolved: no value provided and no default defined"),
    (_COLOR % "", '"title":"m"', '"allOf":[{"x-gts-traits":{"color":5}}]', "trait validation: /color must be string"),
    ('"x-gts-traits-schema":{"allOf":[{"$$ref":"gts://gts.x.trt.a.other§.v1~"}]}', '"title":"m"', '"x-gts-traits":{"color":5}', "trait validation: /color must be string"),
    ('"x-gts-traits-schema":{"$$ref":"gts://gts.x.trt.a.none.v1~"}', '"title":"m"', '"title":"leaf"', "Unresolvable trait schema reference: gts://gts.x.trt.a.none.v1~"),
    ('"x-gts-traits-schema":{"type":"string"}', '"title":"m"', '"title":"leaf"', 'x-gts-traits-schema must have type "object", got "string"'),
    ('"x-gts-traits-schema":{"x-gts-traits":{"a":1}}', '"title":"m"', '"title":"leaf"', "x-gts-traits-schema must not contain x-gts-traits"),
    ('"title":"b"', '"title":"m"', '"x-gts-traits":{"color":"red"}', "x-gts-traits values provided but no x-gts-traits-schema is defined in the inheritance chain"),
]


@query(f"SELECT {cases([_T2])} AS id, {cases([x[3] for x in TRAITS])} AS error FROM part")
def traits_cases(spark, sf_dir):
    other = [schema("gts.x.trt.a.other§.v1~", '"properties":{"color":{"type":"string"}}')]
    levels = [[schema(name, x[i]) for x in TRAITS] for i, name in enumerate((_T0, _T1, _T2))]
    return registry(spark, sf_dir, *levels, other).validate_schemas(wanted(spark, sf_dir, id=[_T2])).select("id", "error")


# --- instances ---

_R, _I = "gts.x.ref.a.s§.v1~", "gts.x.ref.a.s§.v1~x.ref.a.i.v1"
_BAD = "x-gts-ref validation failed: "
POINTED = [  # the instance's members, error
    ('"owner":"gts.x.crm.a.b.v1~"', _BAD + "Referenced entity 'gts.x.crm.a.b.v1~' not found in registry"),
    (f'"own":"{_R}"', ""),
    ('"bad":"gts.x.crm.a.b.v1~"', _BAD + "Cannot resolve reference path '/nope'"),
    ('"kind":"gts.y.a.b.c.v1~"', _BAD + "Value 'gts.y.a.b.c.v1~' does not match pattern 'gts.x.crm.*'"),
    ('"list":["nope",7]', _BAD + "Value 'nope' is not a valid GTS identifier"),
    ('"either":"gts.y.a.b.c.v1~"', _BAD + "Value 'gts.y.a.b.c.v1~' does not match pattern 'gts.x.a.*'; Value 'gts.y.a.b.c.v1~' does not match pattern 'gts.x.b.*'"),
    ('"deep":{"deep":{"n":"x"}}', "/deep/deep/n must be number"),
]


@query(f"SELECT {cases([_I])} AS id, {cases([x[1] for x in POINTED])} AS error FROM part")
def validate_pointers(spark, sf_dir):
    ref = lambda to: f'{{"x-gts-ref":"{to}"}}'
    body = props(f'"owner":{ref("/properties/kind/x-gts-ref")},"own":{ref("/$$id")},"bad":{ref("/nope")},"kind":{ref("gts.x.crm.*")},"list":{{"type":"array","items":{ref("gts.x.*")}}},"either":{{"anyOf":[{ref("gts.x.a.*")},{ref("gts.x.b.*")}]}},"deep":{{"$$ref":"#/$$defs/d"}}')
    # a definition that refers to itself
    body += ',"$$defs":{"d":{"type":"object","properties":{"deep":{"$$ref":"#/$$defs/d"},"n":{"type":"number"}}}}'
    r = registry(spark, sf_dir, [schema(_R, body.replace("#/$$defs", "#/$defs"))], [f'{{"gtsId":"{_I}",{x[0]}}}' for x in POINTED])
    return r.validate_instances(wanted(spark, sf_dir, id=[_I])).select("id", "error")


@query(f"""
WITH c AS ({q.SQL["reg_validate_instances"]}) SELECT id, ok, error, 'instance' AS entity_type FROM c
UNION ALL SELECT '{ORDER_TYPE}', TRUE, '', 'schema' UNION ALL SELECT 'gts.no.such.thing.here.v1~', FALSE, 'Entity not found: gts.no.such.thing.here.v1~', 'unknown'""")
def validate_entities_mixed(spark, sf_dir):
    ids = q.orders(spark, sf_dir, id=q.ORDER_ID).select("id").union(spark.createDataFrame([(ORDER_TYPE,), ("gts.no.such.thing.here.v1~",)], "id string"))
    return q.check_registry(spark, sf_dir).validate_entities(ids)


_K0, _K1, _KI = "gts.x.cst.a.s§.v1.0~", "gts.x.cst.a.s§.v1.1~", "gts.x.cst.a.s§.v1.0~x.cst.a.i.v1.0"
CAST = [  # the instance's members, those of the result, added, removed, error
    ('"a":{"b":1},"list":[{"x":1}],"ref":"gts.x.o.p.q.v1~","zz":0', '"a":{"b":1,"c":7},"list":[{"x":1,"y":"d"}],"ref":"gts.x.o.p.q.v2~"', "a.c,list[0].y", "zz", ""),
    ('"a":{"b":"no"}', '"a":{"b":"no","c":7}', "a.c", "", "/a/b must be integer"),
    ('"a":5', '"a":5', "", "", "/a must be object"),
    ('"list":[]', '"list":[]', "", "", "Missing required property 'a' and no default is defined;  must have required property 'a'"),
]


@query(f"""
SELECT {cases([_KI])} AS instance_id, {cases([f'{{"gtsId":"{_KI}",{x[1]}}}' for x in CAST])} AS casted_entity, {cases([x[2] for x in CAST])} AS added, {cases([x[3] for x in CAST])} AS removed, {cases([x[4] for x in CAST])} AS error FROM part""")
def cast_cases(spark, sf_dir):
    target = '"additionalProperties":false,"required":["a"],' + props('"gtsId":{},"a":{"type":"object","allOf":[{"properties":{"b":{"type":"integer"},"c":{"default":7}}}]},"list":{"type":"array","items":{"type":"object","properties":{"y":{"default":"d"}}}},"ref":{"const":"gts.x.o.p.q.v2~"}')
    r = registry(spark, sf_dir, [schema(_K0, props('"a":{}'))], [schema(_K1, target)], [f'{{"gtsId":"{_KI}",{x[0]}}}' for x in CAST])
    found = r.cast(wanted(spark, sf_dir, id=[_KI], to=[_K1]), "registry")
    return found.select("instance_id", "casted_entity", F.array_join("added_properties", ",").alias("added"), F.array_join("removed_properties", ",").alias("removed"), "error")


_GS = "gts.x.grf.a.s§.v1~"
_GA, _GB, _GX = (f"{_GS}x.grf.a.{n}.v1" for n in "abx")
_GONE = ',"errors":["Entity not found"]'
TREE = f'{{"id":"{_GA}","refs":{{"b":{{"id":"{_GB}","refs":{{"a[0]":{{"id":"{_GA}"}}}},"schema_id":{{"id":"{_GS}"{_GONE}}}}},"gone":{{"id":"{_GX}"{_GONE}}}}},"schema_id":{{"id":"{_GS}"}}}}'


@query(f"SELECT {cases([_GA])} AS id, {cases([TREE])} AS tree FROM part")
def graph_cases(spark, sf_dir):
    """Two documents that name each other, one that isn't there, and a schema that isn't."""
    r = registry(spark, sf_dir, [f'{{"gtsId":"{_GA}","b":"{_GB}","gone":"{_GX}"}}'], [f'{{"gtsId":"{_GB}","a":["{_GA}"]}}'])
    return r.graph(wanted(spark, sf_dir, id=[_GA]))


# --- ingest and files ---


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN 422 WHEN 3 THEN 400 ELSE 200 END AS status,
  CASE p_partkey % 5 WHEN 2 THEN 'x-gts-ref validation failed: q/x-gts-ref: Invalid x-gts-ref value: ''bad'' must start with ''gts.'' or ''/''' WHEN 3 THEN 'Unable to extract GTS ID from entity' END AS reason FROM part""")
def ingest_unchecked(spark, sf_dir):
    return ingested(table(spark, sf_dir, "part").select(KEY, F.expr(q.LINT_DOC).alias("content"))).select(KEY, "status", "reason")
