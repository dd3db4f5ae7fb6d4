"""The registry's operations over identifiers and documents derived from the TPC-H-like tables, each with SQL that computes the same.

Derivations are SQL text that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions import columns
from idloom.operators import identifiers as ids
from idloom.operators.extraction import extracted
from idloom.operators.registry import Registry, ingested, linted
from idloom.operators.tables import spread
from idloom.plans.query import match_each, pattern_condition

ORDER_TYPE = "gts.x.tpch.sales.order.v1~"
META = "http://json-schema.org/draft-07/schema#"
S = "CAST({} AS STRING)".format

ORDER_ID = f"'{ORDER_TYPE}x.tpch.' || lower(o_orderstatus) || '.o' || {S('o_orderkey')} || '.v1.' || {S('o_orderkey % 5')}"
CUSTOMER_ID = f"'gts.x.crm.' || lower(c_mktsegment) || '.customer.v' || {S('1 + c_custkey % 3')} || '~'"
_BASE = "'gts.a.b.c.o' || " + S("o_orderkey")
DIRTY_ID = f"""CASE o_orderkey % 18
  WHEN 0 THEN upper({_BASE} || '.v1~') WHEN 1 THEN {_BASE} || '-x.v1~' WHEN 2 THEN {_BASE} || '~' WHEN 3 THEN {_BASE} || '.v1.00~'
  WHEN 4 THEN 'gts..a.b.c.d.v1~' WHEN 5 THEN {_BASE} || '.v1~~' WHEN 6 THEN {_BASE} || '.v1.' WHEN 7 THEN {_BASE} || '.v1.0'
  WHEN 8 THEN {_BASE} || '.v1~7a1d2f34-5678-49ab-9012-abcdef123456' WHEN 9 THEN {_BASE} || '.v1~x.*' WHEN 10 THEN 'gts.a.*.c.o' || {S('o_orderkey')}
  WHEN 11 THEN 'gts.*.*' WHEN 12 THEN {_BASE} || '.v0~' WHEN 13 THEN 'gts.~a.b.c.d.v' || {S('o_orderkey')} || '~' WHEN 14 THEN '  ' || {_BASE} || '.v1~  '
  WHEN 15 THEN {_BASE} || '.v1~' || repeat('a', 1100) WHEN 16 THEN {_BASE} || '.v1.2~x.y.z.t.v3.4' ELSE 'x.' || {S('o_orderkey')} END"""
ORDER_DOC = f"""'{{"gtsId":"' || {ORDER_ID} || '","status":"' || o_orderstatus || '","prio":"' || o_orderpriority || '","cust":' || {S('o_custkey')} || ',"nest":{{"a":[' || {S('o_orderkey')} || ',' || {S('o_orderkey + 1')} || ']}}}}'"""


def table(spark: SparkSession, sf_dir: str, name: str, *names: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*names or "*"))


def orders(spark: SparkSession, sf_dir: str, **made: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return rows.select("o_orderkey", *[F.expr(e).alias(n) for n, e in made.items()])


def order_registry(spark: SparkSession, sf_dir: str, doc: str = ORDER_DOC) -> Registry:
    """Used once by a query, so not written."""
    return Registry.of(orders(spark, sf_dir, content=doc), seq="o_orderkey", keep=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f"reg_{fn.__name__}"] = fn
        SQL[f"reg_{fn.__name__}"] = sql
        return fn

    return add


# --- identifiers ---

_SEG = r"[a-z_][a-z0-9_]*(\.[a-z_][a-z0-9_]*){3}\.v(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))?"


@query(rf"""
WITH d AS (SELECT o_orderkey, {DIRTY_ID} AS id FROM orders), t AS (SELECT *, trim(id) AS raw FROM d)
SELECT o_orderkey, id, length(raw) <= 1024 AND (
    regexp_full_match(raw, 'gts\.~?({_SEG}~)+({_SEG}|{ids.UUID_TAIL})?')
    OR regexp_full_match(raw, 'gts\.~?({_SEG}~)*([^.~*-]+\.)*\*')) AS ok,
  contains(id, '*') AS is_wildcard,
  regexp_full_match(raw, 'gts\.~?({_SEG}~)+({_SEG}|{ids.UUID_TAIL})?') AND length(raw) <= 1024 AND starts_with(id, 'gts.') OR regexp_full_match(id, 'gts\.~?({_SEG}~)*([^.~*-]+\.)*\*') AS strict
FROM t""")
def validate_id(spark, sf_dir):
    v = columns.validation(F.col("id"))
    return orders(spark, sf_dir, id=DIRTY_ID).select("o_orderkey", "id", v.alias("v"), columns.is_valid(F.col("id")).alias("strict")).select("o_orderkey", "id", "v.ok", "v.is_wildcard", "strict")


@query(f"""
WITH d AS (SELECT o_orderkey, {DIRTY_ID} AS id FROM orders), e AS (
  SELECT o_orderkey, id, CASE
    WHEN contains(id, '*') AND length(id) - length(replace(id, '*', '')) > 1 THEN '{ids.ONE_STAR.replace("'", "''")}'
    WHEN contains(id, '*') AND NOT ends_with(id, '*') THEN '{ids.STAR_END.replace("'", "''")}'
    WHEN id <> lower(id) THEN '{ids.LOWER}' WHEN NOT starts_with(trim(id), 'gts.') THEN '{ids.NO_PREFIX.replace("'", "''")}'
    WHEN length(trim(id)) > 1024 THEN '{ids.TOO_LONG}' WHEN contains(id, '..') THEN '{ids.DOUBLE_DOT}'
    WHEN ends_with(id, '.') THEN '{ids.END_DOT}' WHEN contains(id, '~~') THEN '{ids.DOUBLE_TILDE}'
    WHEN o_orderkey % 18 = 1 THEN '{ids.HYPHEN.replace("'", "''")}' WHEN o_orderkey % 18 = 7 THEN '{ids.SINGLE}' END AS cause,
    CASE o_orderkey % 18 WHEN 2 THEN '{ids.TOO_FEW}' WHEN 3 THEN '{ids.MINOR_INT}' END AS inner_cause FROM d)
SELECT o_orderkey, CASE WHEN cause IS NOT NULL THEN 'Invalid GTS identifier: ' || id || ': ' || cause ELSE 'Invalid GTS segment #1 @ offset 4: ''' || substr(id, 5) || ''': ' || inner_cause END AS error
FROM e WHERE cause IS NOT NULL OR inner_cause IS NOT NULL""")
def validate_errors(spark, sf_dir):
    return orders(spark, sf_dir, id=DIRTY_ID).select("o_orderkey", columns.error(F.col("id")).alias("error")).filter("error is not null")


@query(f"""
WITH i AS (SELECT o_orderkey, {ORDER_ID} AS id FROM orders),
p AS (SELECT o_orderkey, id, unnest(range(1, 3)) AS num FROM i),
s AS (SELECT o_orderkey, num, CASE num WHEN 1 THEN 4 ELSE 5 + length(split_part(substr(id, 5), '~', 1)) END AS "offset", split_part(substr(id, 5), '~', num::INTEGER) AS body FROM p)
SELECT o_orderkey, num::INTEGER AS num, "offset"::INTEGER AS "offset", body || CASE num WHEN 1 THEN '~' ELSE '' END AS segment, split_part(body, '.', 1) AS vendor, split_part(body, '.', 2) AS package,
  split_part(body, '.', 3) AS namespace, split_part(body, '.', 4) AS type, substr(split_part(body, '.', 5), 2)::BIGINT AS ver_major,
  TRY_CAST(nullif(split_part(body, '.', 6), '') AS BIGINT) AS ver_minor, num = 1 AS is_type, FALSE AS is_wildcard, FALSE AS is_uuid_tail FROM s""")
def parse_segments(spark, sf_dir):
    return orders(spark, sf_dir, id=ORDER_ID).select("o_orderkey", F.inline(columns.segments(F.col("id"))))


@query(f"""
WITH i AS (SELECT c_custkey, {CUSTOMER_ID} AS id FROM customer), h AS (SELECT c_custkey, id, sha1(from_hex('{ids.NAMESPACE.hex}') || encode(id)) AS d FROM i)
SELECT c_custkey, id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(d, 17, 1))::INTEGER, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS uuid FROM h""")
def uuid(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(CUSTOMER_ID).alias("id")).select("c_custkey", "id", columns.id_uuid(F.col("id"))["uuid"].alias("uuid"))


PATTERNS = (ORDER_TYPE, f"{ORDER_TYPE}x.tpch.f.*", "gts.x.tpch.*", "gts.x.*", "gts.y.*", f"{ORDER_TYPE}*", "gts.x.tpch.sales.order.v2~", "gts.x.a*")


@query(f"SELECT o_orderkey, {ORDER_ID} AS id, o_orderstatus = 'F' AS match FROM orders")
def match_wildcard(spark, sf_dir):
    found = orders(spark, sf_dir, id=ORDER_ID)
    return found.select("o_orderkey", "id", pattern_condition(PATTERNS[1], columns.segments(F.col("id"))).alias("match"))


@query(f"""
SELECT o_orderkey, p AS pattern, CASE p WHEN '{PATTERNS[1]}' THEN o_orderstatus = 'F' WHEN 'gts.y.*' THEN FALSE WHEN '{PATTERNS[6]}' THEN FALSE WHEN 'gts.x.a*' THEN FALSE ELSE TRUE END AS match,
  CASE p WHEN 'gts.x.a*' THEN 'Invalid GTS identifier: gts.x.a*: ' || '{ids.STAR_BORDER.replace("'", "''")}' END AS error
FROM orders, (SELECT unnest([{", ".join(f"'{p}'" for p in PATTERNS)}]) AS p)""")
def match_patterns(spark, sf_dir):
    found = orders(spark, sf_dir, id=ORDER_ID).select("o_orderkey", columns.segments(F.col("id")).alias("s"), columns.error(F.col("id")).alias("e"))
    return found.select("o_orderkey", F.inline(match_each(list(PATTERNS), F.col("s"), F.col("e"))))


_CODE = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATTERNS))


@query(f"""
SELECT o_orderkey, p AS pattern, CASE p WHEN '{PATTERNS[1]}' THEN o_orderstatus = 'F' WHEN 'gts.y.*' THEN FALSE WHEN '{PATTERNS[6]}' THEN FALSE WHEN 'gts.x.a*' THEN FALSE ELSE TRUE END AS match
FROM (SELECT *, CASE o_orderkey % 8 {_CODE} END AS p FROM orders)""")
def match_columns(spark, sf_dir):
    found = orders(spark, sf_dir, id=ORDER_ID, pattern=f"CASE o_orderkey % 8 {_CODE} END")
    return found.select("o_orderkey", "pattern", columns.matches(F.col("id"), F.col("pattern"))["match"].alias("match"))


# --- documents ---


@query(f"SELECT o_orderkey, {ORDER_ID} AS id, '{ORDER_TYPE}' AS schema_id, 'gtsId' AS selected_entity_field, 'gtsId' AS selected_schema_id_field, FALSE AS is_schema FROM orders")
def extract_id(spark, sf_dir):
    return orders(spark, sf_dir, content=ORDER_DOC).select("o_orderkey", extracted(F.col("content")).alias("x")).select("o_orderkey", "x.*")


_FIELDS = f"""CASE o_orderkey % 6
  WHEN 0 THEN '{{"id":"low","gtsId":"' || {ORDER_ID} || '"}}' WHEN 1 THEN '{{"id":" padded ","type":"{ORDER_TYPE}"}}'
  WHEN 2 THEN '{{"$id":"gts://{ORDER_TYPE}","$schema":"{META}"}}' WHEN 3 THEN '{{"$$id":"' || {ORDER_ID} || '","gtsTid":"{ORDER_TYPE}"}}'
  WHEN 4 THEN '{{"name":"none"}}' ELSE '{{"gts_id":"x","schema":"nope","type":5}}' END"""


@query(f"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN {ORDER_ID} WHEN 1 THEN 'padded' WHEN 2 THEN '{ORDER_TYPE}' WHEN 3 THEN {ORDER_ID} WHEN 4 THEN '' ELSE 'x' END AS id,
  CASE o_orderkey % 6 WHEN 2 THEN '{META}' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE '{ORDER_TYPE}' END AS schema_id, o_orderkey % 6 = 2 AS is_schema FROM orders""")
def extract_precedence(spark, sf_dir):
    return orders(spark, sf_dir, content=_FIELDS).select("o_orderkey", extracted(F.col("content")).alias("x")).select("o_orderkey", "x.id", "x.schema_id", "x.is_schema")


@query(f"""
SELECT id, min(c_custkey) AS ord, arg_max(content, c_custkey) AS content FROM (
  SELECT c_custkey, {CUSTOMER_ID} AS id, '{{"gtsId":"' || {CUSTOMER_ID} || '","n":' || {S('c_custkey')} || '}}' AS content FROM customer) GROUP BY id""")
def last_write_wins(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"""'{{"gtsId":"' || {CUSTOMER_ID} || '","n":' || {S('c_custkey')} || '}}'""").alias("content"))
    return Registry.of(docs, seq="c_custkey", keep=False).entities.select("id", "ord", "content")


@query(f"SELECT {ORDER_ID} AS id, o_orderkey AS ord FROM orders ORDER BY o_orderkey LIMIT 100")
def list_ids(spark, sf_dir):
    return order_registry(spark, sf_dir).ids()


@query(f"SELECT {ORDER_ID} AS id, {ORDER_DOC} AS content FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def get(spark, sf_dir):
    first = orders(spark, sf_dir, id=ORDER_ID).orderBy("o_orderkey").first()["id"]
    return order_registry(spark, sf_dir).get(first)


@query(f"SELECT {ORDER_ID} AS id, o_orderkey AS ord, {ORDER_DOC} AS content FROM orders WHERE o_orderstatus = 'F'")
def query_wildcard(spark, sf_dir):
    return order_registry(spark, sf_dir).query(f"{ORDER_TYPE}x.tpch.f.*", None)


@query(f"SELECT {ORDER_ID} AS id, o_orderkey AS ord, {ORDER_DOC} AS content FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def query_filter(spark, sf_dir):
    return order_registry(spark, sf_dir).query(f"{ORDER_TYPE}x.tpch.*[status=F, cust=\"7\", prio=*]", None)


@query(f"SELECT {ORDER_ID} AS id, o_orderkey AS ord, {ORDER_DOC} AS content FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25")
def query_limit(spark, sf_dir):
    return order_registry(spark, sf_dir).query("gts.x.tpch.*[status=O]", 25)


EVENT_ID = f"'gts.x.web.log.event.v1~x.web.log.e' || {S('event_id')} || '.v1'"


@query(f"""
SELECT {EVENT_ID} AS id, p AS path, p <> 'none' AS resolved, CASE p WHEN 'props.k' THEN json_extract_string(props, '$.k') WHEN 'tags[1]' THEN {S('event_id')} END AS value, NULL::VARCHAR AS error
FROM events, (SELECT unnest(['props.k', 'tags[1]', 'none']) AS p)""")
def attributes(spark, sf_dir):
    doc = f"""'{{"gtsId":"' || {EVENT_ID} || '","props":' || props || ',"tags":[0,' || {S('event_id')} || ']}}'"""
    events = table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.expr(EVENT_ID).alias("id"), F.expr(doc).alias("content"))
    wanted = events.select("id", F.explode(F.array(F.lit("props.k"), F.lit("tags[1]"), F.lit("none"))).alias("path"))
    return Registry.of(events, seq="event_id").attributes(wanted)


# --- references ---

REF_DOC = f"""'{{"gtsId":"' || {ORDER_ID} || '","next":{{"$ref":"gts://{ORDER_TYPE}x.tpch.n.o' || {S('o_orderkey % 50')} || '.v1"}},"also":["' || {CUSTOMER_ID.replace('c_custkey', 'o_custkey').replace('lower(c_mktsegment)', "'any'")} || '"]}}'"""
_NEXT = f"'{ORDER_TYPE}x.tpch.n.o' || {S('o_orderkey % 50')} || '.v1'"
_NEXT_DOC = f"""'{{"gtsId":"{ORDER_TYPE}x.tpch.n.o' || {S('n_nationkey')} || '.v1"}}'"""


def _reference_registry(spark, sf_dir) -> Registry:
    more = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("o_orderkey"), F.expr(_NEXT_DOC).alias("content"))
    return Registry.of(orders(spark, sf_dir, content=REF_DOC).unionByName(more), seq="o_orderkey")


@query(f"""
SELECT id, unnest([{ORDER_TYPE!r}, nxt]) AS ref FROM (SELECT {ORDER_ID} AS id, {_NEXT} AS nxt FROM orders)
UNION ALL SELECT '{ORDER_TYPE}x.tpch.n.o' || {S('n_nationkey')} || '.v1', '{ORDER_TYPE}' FROM nation""")
def references(spark, sf_dir):
    return _reference_registry(spark, sf_dir).references()


@query(f"""
WITH e AS (SELECT id, unnest(['{ORDER_TYPE}', nxt]) AS ref FROM (SELECT {ORDER_ID} AS id, {_NEXT} AS nxt FROM orders)
  UNION ALL SELECT '{ORDER_TYPE}x.tpch.n.o' || {S('n_nationkey')} || '.v1', '{ORDER_TYPE}' FROM nation)
SELECT id, ref FROM e WHERE ref NOT IN (SELECT '{ORDER_TYPE}x.tpch.n.o' || {S('n_nationkey')} || '.v1' FROM nation)""")
def broken_references(spark, sf_dir):
    return _reference_registry(spark, sf_dir).broken_references()


@query(f"""
SELECT {ORDER_ID} AS id, '{ORDER_TYPE},' || {_NEXT} AS relationships, CASE WHEN o_orderkey % 50 < 25 THEN '{ORDER_TYPE}' ELSE '{ORDER_TYPE},' || {_NEXT} END AS broken FROM orders""")
def relationships(spark, sf_dir):
    found = _reference_registry(spark, sf_dir).relationships(orders(spark, sf_dir, id=ORDER_ID))
    return found.select("id", F.array_join("relationships", ",").alias("relationships"), F.array_join("brokenReferences", ",").alias("broken"))


@query(f"""
SELECT {ORDER_ID} AS id, 'gtsId' AS path, {ORDER_ID} AS ref FROM orders
UNION ALL SELECT {ORDER_ID}, 'also[0]', {CUSTOMER_ID.replace('c_custkey', 'o_custkey').replace('lower(c_mktsegment)', "'any'")} FROM orders
UNION ALL SELECT '{ORDER_TYPE}x.tpch.n.o' || {S('n_nationkey')} || '.v1', 'gtsId', '{ORDER_TYPE}x.tpch.n.o' || {S('n_nationkey')} || '.v1' FROM nation""")
def mentions(spark, sf_dir):
    return _reference_registry(spark, sf_dir).mentions()


# --- validation ---

ORDER_SCHEMA = f"""{{"$$id":"{ORDER_TYPE}","$$schema":"{META}","type":"object","required":["status","cust"],"properties":{{"status":{{"enum":["F","O"]}},"cust":{{"type":"integer","minimum":5}},"owner":{{"type":"string","x-gts-ref":"gts.x.crm.*"}}}}}}"""
CHECK_DOC = f"""'{{"gtsId":"' || {ORDER_ID} || '"' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ',"status":"' || o_orderstatus || '"' END || ',"cust":' || {S('o_custkey % 20')} || CASE o_orderkey % 4 WHEN 0 THEN ',"owner":"gts.x.crm.a.b.v1~"' WHEN 1 THEN ',"owner":"nope"' ELSE '' END || '}}'"""


@query(f"""
WITH c AS (SELECT o_orderkey, {ORDER_ID} AS id, CASE
  WHEN o_orderkey % 7 = 0 THEN '/ must have required property ''status'''
  WHEN o_orderstatus NOT IN ('F', 'O') THEN '/status must be equal to one of the allowed values'
  WHEN o_custkey % 20 < 5 THEN '/cust must be >= 5'
  WHEN o_orderkey % 4 = 0 THEN 'x-gts-ref validation failed: Referenced entity ''gts.x.crm.a.b.v1~'' not found in registry'
  WHEN o_orderkey % 4 = 1 THEN 'x-gts-ref validation failed: Value ''nope'' is not a valid GTS identifier' ELSE '' END AS error FROM orders)
SELECT id, error = '' AS ok, error = '' AS valid, error FROM c""")
def validate_instances(spark, sf_dir):
    return check_registry(spark, sf_dir).validate_instances(orders(spark, sf_dir, id=ORDER_ID))


def check_registry(spark: SparkSession, sf_dir: str) -> Registry:
    docs = orders(spark, sf_dir, content=CHECK_DOC).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("o_orderkey"), F.lit(ORDER_SCHEMA).alias("content")))
    return Registry.of(docs, seq="o_orderkey")


PART_ID = "'gts.x.cat.a.p' || " + S("p_partkey") + " || '.v{}~'"


def _part_schema(version: int, extra: str) -> str:
    own = PART_ID.format(version)
    return f"""'{{"$$id":"' || {own} || '","$$schema":"{META}","type":"object","required":["name"' || {extra} || '}}}}'"""


PART_V1 = _part_schema(1, f"""'],"properties":{{"name":{{"type":"string","maxLength":' || {S('10 + p_size')} || '}},"size":{{"type":"integer"}}'""")
PART_V2 = _part_schema(2, f"""CASE WHEN p_partkey % 3 = 0 THEN ',"color"' ELSE '' END || '],"properties":{{"name":{{"type":"string","maxLength":' || {S('10 + p_size + p_partkey % 3 - 1')} || '}},"size":{{"type":"' || CASE WHEN p_partkey % 5 = 0 THEN 'string' ELSE 'integer' END || '"}},"color":{{"type":"string","default":"red"}}'""")


def _part_registry(spark, sf_dir, more: str | None = None) -> Registry:
    parts = table(spark, sf_dir, "part")
    docs = F.array(F.expr(PART_V1), F.expr(PART_V2), *([F.expr(more)] if more else []))
    return Registry.of(parts.select("p_partkey", F.posexplode(docs).alias("pos", "content")).select((F.col("p_partkey") * 3 + F.col("pos")).alias("seq"), "content"))


def _part_pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(PART_ID.format(1)).alias("old"), F.expr(PART_ID.format(2)).alias("new"))


def _compat(df: DataFrame) -> DataFrame:
    return df.select("old", "new", "direction", "is_fully_compatible", F.array_join("backward_errors", "; ").alias("backward"), F.array_join("forward_errors", "; ").alias("forward"), F.array_join("incompatibility_reasons", "; ").alias("reasons"))


@query(f"""
WITH e AS (SELECT {PART_ID.format(1)} AS old, {PART_ID.format(2)} AS new,
  CASE WHEN p_partkey % 5 = 0 THEN 'Property ''size'' type incompatibly changed from integer to string' ELSE '' END AS backward,
  concat_ws('; ', CASE WHEN p_partkey % 5 = 0 THEN 'Property ''size'' type incompatibly changed from integer to string' END, CASE WHEN p_partkey % 3 = 0 THEN 'New required property ''color'' added' END) AS forward FROM part)
SELECT old, new, 'upgrade' AS direction, backward = '' AND forward = '' AS is_fully_compatible, backward, forward, concat_ws('; ', nullif(backward, ''), nullif(forward, '')) AS reasons FROM e""")
def compat_library(spark, sf_dir):
    return _compat(_part_registry(spark, sf_dir).compatibility(_part_pairs(spark, sf_dir), "library"))


@query(f"""
WITH e AS (SELECT {PART_ID.format(1)} AS old, {PART_ID.format(2)} AS new,
  concat_ws('; ', CASE WHEN p_partkey % 3 = 0 THEN 'Added required properties: color' END,
    CASE WHEN p_partkey % 3 = 0 THEN 'Property ''name'' maxLength decreased from ' || {S('10 + p_size')} || ' to ' || {S('9 + p_size')} END,
    CASE WHEN p_partkey % 5 = 0 THEN 'Property ''size'' type changed from integer to string' END) AS backward,
  concat_ws('; ', CASE WHEN p_partkey % 3 = 2 THEN 'Property ''name'' maxLength increased from ' || {S('10 + p_size')} || ' to ' || {S('11 + p_size')} END,
    CASE WHEN p_partkey % 5 = 0 THEN 'Property ''size'' type changed from integer to string' END) AS forward FROM part)
SELECT old, new, 'unknown' AS direction, backward = '' AND forward = '' AS is_fully_compatible, backward, forward, '' AS reasons FROM e""")
def compat_registry(spark, sf_dir):
    return _compat(_part_registry(spark, sf_dir).compatibility(_part_pairs(spark, sf_dir), "registry"))


ITEM_ID = "'gts.x.cat.a.p' || " + S("p_partkey") + " || '.v1~x.cat.a.i.v1.0'"
ITEM_DOC = f"""'{{"gtsId":"' || {ITEM_ID} || '","name":"n' || {S('p_partkey')} || '","size":' || {S('p_size')} || ',"extra":1}}'"""


def _casts(spark, sf_dir, flavor: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.expr(ITEM_ID).alias("id"), F.expr(PART_ID.format(2)).alias("to"))
    return _part_registry(spark, sf_dir, ITEM_DOC).cast(pairs, flavor)


@query(f"""
WITH e AS (SELECT p_partkey, p_size, concat_ws('; ', CASE WHEN p_partkey % 5 = 0 THEN 'Property ''size'' type incompatibly changed from integer to string; Property ''size'' type incompatibly changed from integer to string' END,
    CASE WHEN p_partkey % 3 = 0 THEN 'New required property ''color'' added' END) AS reasons FROM part)
SELECT {ITEM_ID} AS "fromId", {PART_ID.format(2)} AS "toId", reasons = '' AS ok,
  CASE WHEN reasons = '' THEN '{{"gtsId":"' || replace({ITEM_ID}, 'v1.0', 'v2.0') || '","name":"n' || {S('p_partkey')} || '","size":' || {S('p_size')} || ',"color":"red"}}' END AS result,
  CASE WHEN reasons <> '' THEN 'Schemas are not compatible: ' || reasons END AS error FROM e""")
def cast_library(spark, sf_dir):
    return _casts(spark, sf_dir, "library").select("fromId", "toId", "ok", "result", "error")


@query(f"""
SELECT {ITEM_ID} AS instance_id, {PART_ID.format(2)} AS to_schema_id, p_partkey % 5 <> 0 AS ok,
  '{{"gtsId":"' || {ITEM_ID} || '","name":"n' || {S('p_partkey')} || '","size":' || {S('p_size')} || ',"extra":1,"color":"red"}}' AS casted_entity, 'color' AS added,
  CASE WHEN p_partkey % 5 = 0 THEN '/size must be string' ELSE '' END AS error FROM part""")
def cast_registry(spark, sf_dir):
    return _casts(spark, sf_dir, "registry").select("instance_id", "to_schema_id", "ok", "casted_entity", F.array_join("added_properties", ",").alias("added"), "error")


# --- inheritance ---

_S_BASE = "'gts.x.sup.a.s' || " + S("s_suppkey") + " || '.v1~'"
_S_CHILD = f"{_S_BASE} || 'x.sup.a.c.v1~'"
SUPPLIER_BASE = f"""'{{"$$id":"' || {_S_BASE} || '","$$schema":"{META}","properties":{{"n":{{"type":"integer","maximum":' || {S('s_nationkey')} || '}}}},"x-gts-traits-schema":{{"type":"object","properties":{{"color":{{"type":"string"}}}},"additionalProperties":false}}}}'"""
SUPPLIER_CHILD = f"""'{{"$$id":"' || {_S_CHILD} || '","$$schema":"{META}","allOf":[{{"$$ref":"gts://' || {_S_BASE} || '"}},{{"properties":{{"n":{{"type":"integer","maximum":' || {S('s_suppkey % 25')} || '}}}}}}]' || CASE s_suppkey % 3 WHEN 0 THEN ',"x-gts-traits":{{"color":"red"}}' WHEN 1 THEN ',"x-gts-traits":{{"color":5}}' ELSE '' END || '}}'"""


def _supplier_registry(spark, sf_dir) -> Registry:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.array(F.expr(SUPPLIER_BASE), F.expr(SUPPLIER_CHILD))).alias("pos", "content"))
    return Registry.of(rows.select((F.col("s_suppkey") * 2 + F.col("pos")).alias("seq"), "content"))


def _supplier_ids(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.expr(_S_CHILD).alias("id"))


_S_ERROR = f"""CASE WHEN s_suppkey % 25 > s_nationkey THEN 'Property ''n'' loosens ''maximum'' from ' || {S('s_nationkey')} || ' to ' || {S('s_suppkey % 25')}
  WHEN s_suppkey % 3 = 1 THEN 'trait validation: /color must be string' WHEN s_suppkey % 3 = 2 THEN 'trait property ''color'' is not resolved: no value provided and no default defined' ELSE '' END"""


@query(f"SELECT {_S_CHILD} AS id, {_S_ERROR} = '' AS ok, {_S_ERROR} AS error FROM supplier")
def schema_parents(spark, sf_dir):
    return _supplier_registry(spark, sf_dir).validate_schemas(_supplier_ids(spark, sf_dir))


@query(f"SELECT {_S_CHILD} AS id, s_suppkey % 3 <> 2 AS ok, CASE WHEN s_suppkey % 3 = 2 THEN 'Entity defines x-gts-traits-schema but no x-gts-traits values are provided' ELSE '' END AS error FROM supplier")
def entity_traits(spark, sf_dir):
    return _supplier_registry(spark, sf_dir).validate_entity_traits(_supplier_ids(spark, sf_dir))


@query(f"SELECT {_S_CHILD} AS id, {_S_ERROR} = '' AS ok, {_S_ERROR} AS error, 'schema' AS entity_type FROM supplier")
def validate_entities(spark, sf_dir):
    return _supplier_registry(spark, sf_dir).validate_entities(_supplier_ids(spark, sf_dir))


# --- ingest ---

LINT_DOC = f"""CASE p_partkey % 5 WHEN 0 THEN '{{"$schema":"{META}","$id":"gts.a.b.c.d.v1~"}}' WHEN 1 THEN '{{"$schema":"{META}","$id":"gts://gts.a.b.c.p' || {S('p_partkey')} || '.v1~","p":{{"$ref":"gts.a.b.c.d.v1~"}}}}'
  WHEN 2 THEN '{{"$schema":"{META}","$id":"gts://gts.a.b.c.p' || {S('p_partkey')} || '.v1~","q":{{"x-gts-ref":"bad"}}}}' WHEN 3 THEN '{{"name":"x"}}' ELSE '{{"$schema":"{META}","$id":"gts://gts.a.b.c.p' || {S('p_partkey')} || '.v1~"}}' END"""
_LINT = """CASE p_partkey % 5 WHEN 0 THEN 'Schema $id with GTS identifier must use gts:// URI format (e.g., gts://gts.vendor.pkg.ns.type.v1~)' WHEN 1 THEN 'Invalid $ref at p/$ref: GTS references must use gts:// URI format' END"""


@query(f"SELECT p_partkey, {_LINT} AS lint FROM part")
def lint_schemas(spark, sf_dir):
    return linted(table(spark, sf_dir, "part").select("p_partkey", F.expr(LINT_DOC).alias("content"))).select("p_partkey", "lint")


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN 422 ELSE 200 END AS status, CASE p_partkey % 5 WHEN 2 THEN 'x-gts-ref validation failed: q/x-gts-ref: Invalid x-gts-ref value: ''bad'' must start with ''gts.'' or ''/'''
  WHEN 3 THEN 'Instance must have a valid GTS ID or type field' ELSE {_LINT} END AS reason FROM part""")
def ingest(spark, sf_dir):
    return ingested(table(spark, sf_dir, "part").select("p_partkey", F.expr(LINT_DOC).alias("content")), validate=True).select("p_partkey", "status", "reason")


@query(f"""SELECT {_S_CHILD} AS id, '{{"id":"' || {_S_CHILD} || '","schema_id":{{"id":"' || {_S_BASE} || '"}}}}' AS tree FROM supplier""")
def graph(spark, sf_dir):
    return _supplier_registry(spark, sf_dir).graph(_supplier_ids(spark, sf_dir))
