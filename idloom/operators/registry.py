"""A registry of JSON documents by identifier, as a DataFrame, and all bulk operations over it.

Registering keeps the first position and the last content of an id. Whatever looks up other documents is joins: what a document needs
(its schema, what that refers to, its chain) is gathered as an environment, in as many rounds as references are deep,
and handed to the document logic a row at a time. Environments are gathered once for each schema, not for each instance.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions import columns
from idloom.operators import casting, compatibility, documents, inheritance
from idloom.operators import identifiers as ids
from idloom.operators.documents import Entity, dumps
from idloom.operators.extraction import extract, extracted
from idloom.operators.tables import per_row, written
from idloom.plans.query import LIMIT, condition, parse_query, pattern_condition

_LOADED = lru_cache(maxsize=4096)(json.loads)
NO_AT = "Invalid attribute path: missing @"  # fixed value
COMPATIBILITY = "`from` string, `to` string, old string, new string, direction string, added_properties array<string>, removed_properties array<string>, changed_properties array<map<string,string>>, is_fully_compatible boolean, is_backward_compatible boolean, is_forward_compatible boolean, incompatibility_reasons array<string>, backward_errors array<string>, forward_errors array<string>"
CASTS = {
    "library": "ok boolean, fromId string, toId string, result string, error string",
    "registry": COMPATIBILITY + ", casted_entity string, instance_id string, to_schema_id string, ok boolean, error string",
}


#: Fields of the first segment that are columns of their own.
FIRST = (*ids.NAMES, "ver_major", "ver_minor", "is_type", "segment")


def _first(field: str) -> str:
    return f"first_{field}"


def load(text: str | None) -> object:
    """Parsed JSON, shared between rows; not to be changed. Later duplicates of a key win."""
    try:
        return _LOADED(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


def lookup_key(text: Column) -> Column:
    """What an id is looked up by: valid ids without outer spaces, others as they are."""
    return F.when(columns.is_valid(text), columns.strip(text)).otherwise(text)


def _entity(row: dict | None) -> Entity | None:
    return Entity(row["id"], row["schema_id"], row["is_schema"], load(row["content"]), row["content"]) if row else None


def _finder(env: list[dict] | None) -> documents.Find:
    rows = {r["id"]: r for r in env or ()}
    return lambda name: _entity(rows.get(name))


def _needs(row: dict) -> Iterator[dict]:
    """The ids that a document's own schema and references name; with `all`, those that it mentions anywhere."""
    content = load(row["content"])
    names = {row["schema_id"]}
    for _, node in documents.walk(content):
        if isinstance(node, dict):
            names |= {documents.bare(node[k]).partition("#")[0] for k in ("$ref", "$$ref") if isinstance(node.get(k), str)}
    if row["all"]:
        names |= {i for _, i in documents.mentioned_ids(content)}
    for n in names - {None, ""}:
        yield {"key": row["key"], "id": n}


class Registry:
    def __init__(self, entities: DataFrame):
        """entities: id, ord, content, schema_id, is_schema, segments (null if the id isn't valid), and the first segment's
        fields as columns of their own, on which scans of a saved registry are pruned."""
        self.entities = entities

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    @classmethod
    def of(cls, docs: DataFrame, content: str = "content", seq: str = "seq", keep: bool = True) -> Registry:
        """Registers documents in the order of seq. keep: writes the registry once; else every use extracts and parses anew."""
        found = docs.select(F.col(seq).alias("seq"), F.col(content).alias("content"), extracted(F.col(content)).alias("x"))
        found = found.select("seq", "content", "x", F.when(columns.valid_or_null(F.col("x.id")), columns.segments(F.col("x.id"))).alias("segments"))
        # equal ids have equal segments; as results of the aggregation they are parsed once, however often conditions name them
        last = F.max_by(F.struct("content", "x.schema_id", "x.is_schema"), "seq").alias("last")
        kept = found.groupBy(F.col("x.id").alias("id")).agg(F.min("seq").alias("ord"), last, F.first("segments").alias("segments"))
        kept = kept.select("id", "ord", "last.content", "last.schema_id", "last.is_schema", "segments")
        registry = cls(kept.withColumns({_first(n): F.get("segments", F.lit(0))[n] for n in FIRST}))
        return registry.kept() if keep else registry

    def save(self, path: str) -> None:
        """Sorted by id, so that lookups and queries skip files and row groups by their statistics."""
        self.entities.sort("id").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        return cls(spark.read.parquet(path))

    def kept(self) -> Registry:
        """The same, computed once."""
        return Registry(written(self.entities))

    def unresolved_references(self) -> DataFrame:
        """id, ref: declared references that weren't registered before their document."""
        refs = per_row(self.entities.select("id", "ord", "content"), lambda r: [{"id": r["id"], "ord": r["ord"], "ref": x} for x in documents.declared_references(load(r["content"]))], "id string, ord bigint, ref string")
        there = self.entities.select(F.col("id").alias("ref"), F.col("ord").alias("since"))
        return refs.join(there, (refs["ref"] == there["ref"]) & (there["since"] < refs["ord"]), "left_anti").select("id", "ref")

    # --- lookups and queries ---

    def get(self, entity_id: str) -> DataFrame:
        return self.entities.filter(F.col("id") == entity_id).select("id", "content")

    def ids(self, limit: int | None = LIMIT, clamp: bool = True) -> DataFrame:
        """The first ids in registration order; clamped to 1 to 1000, or as a slice: below zero counts from the end."""
        ordered = self.entities.select("id", "ord").orderBy("ord")
        if clamp:
            limit = min(1000, max(1, limit))
        elif limit is not None and limit < 0:
            limit = max(0, self.entities.count() + limit)
        return ordered.limit(limit) if limit is not None else ordered

    def query(self, text: str, limit: float | None = LIMIT) -> DataFrame:
        """id, ord and content of matches, in registration order; none if the expression is in error (see parse_query).
        A limit that is no number is no limit."""
        parsed = parse_query(text)
        found = self.entities.filter(F.lit(False) if parsed.error else condition(parsed, F.col("segments"), F.col("content"), lambda n: F.col(_first(n))))
        ordered = found.select("id", "ord", "content").orderBy("ord")
        return ordered if limit is None or limit != limit else ordered.limit(max(0, int(limit)))

    def query_result(self, text: str, limit: float | None = LIMIT) -> dict:
        """query, count, items, limit, error. The items come to the driver, so a limit is needed."""
        if limit is None or limit != limit:
            raise ValueError("a result of unbounded size; use query for a DataFrame")
        items = [r["content"] for r in self.query(text, limit).collect()]
        return {"query": text, "count": len(items), "items": items, "limit": limit, "error": parse_query(text).error}

    def query_response(self, text: str, limit: float = LIMIT) -> dict:
        """error (empty if there is none), count, limit, results."""
        found = self.query_result(text, limit)
        return {"error": found["error"] or "", "count": found["count"], "limit": limit, "results": found["items"]}

    def query_ids(self, pattern: str, limit: int | None = None) -> DataFrame:
        found = self.entities.filter(pattern_condition(pattern, F.col("segments"), lambda n: F.col(_first(n)))).select("id", "ord").orderBy("ord")
        return found if limit is None else found.limit(limit)

    def query_bool(self, condition_: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
        """An extension: conditions combined with &, | and ~, e.g. lambda q: q('a.*') & ~q('b.*')."""
        one = lambda text: condition(parse_query(text), F.col("segments"), F.col("content"), lambda n: F.col(_first(n)))
        return self.entities.filter(condition_(one)).select("id", "ord", "content").orderBy("ord")

    def attributes(self, wanted: DataFrame) -> DataFrame:
        """id, path, resolved, value (JSON), error for rows of id and path."""

        def value(row: dict) -> list[dict]:
            out = {"id": row["id"], "path": row["path"], "resolved": False, "value": None, "error": None}
            if not row["there"]:
                return [out | {"error": f"Entity not found: {row['id']}"}]
            v = documents.attribute(load(row["content"]), row["path"])
            return [out if v is documents.MISSING else out | {"resolved": True, "value": dumps(v)}]

        there = self.entities.select("id", "content", F.lit(True).alias("there"))
        failed = lambda row, e: {"id": row["id"], "path": row["path"], "resolved": False, "value": None, "error": e}
        return per_row(wanted.select("id", "path").join(there, "id", "left"), value, "id string, path string, resolved boolean, value string, error string", failed)

    def attributes_at(self, wanted: DataFrame, strict: bool = False) -> DataFrame:
        """As attributes, for rows of `at`, an id and a path with @ between; path is all of `at` if there is none. strict: what hasn't
        exactly two parts is an id with an empty path, which stands for the whole document."""
        at = F.instr("at", "@")
        if strict:
            parts = F.split("at", "@", -1)
            two = F.size(parts) == 2
            return self.attributes(wanted.select(F.when(two, parts[0]).otherwise(F.col("at")).alias("id"), F.when(two, F.get(parts, F.lit(1))).otherwise("").alias("path")))
        good = wanted.filter(at > 0).select(F.expr("left(at, instr(at, '@') - 1)").alias("id"), F.expr("substr(at, instr(at, '@') + 1)").alias("path"))
        bad = wanted.filter(at == 0).select(F.lit(None).cast("string").alias("id"), F.col("at").alias("path"), F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("value"), F.lit(NO_AT).alias("error"))
        return self.attributes(good).unionByName(bad)

    # --- references ---

    def references(self) -> DataFrame:
        """id, ref: the edges of all documents, to what they declare and to their schema."""
        found = per_row(self.entities.select("id", "schema_id", "content"), lambda r: [{"id": r["id"], "ref": x} for x in {*documents.declared_references(load(r["content"])), r["schema_id"]} - {None, ""}], "id string, ref string")
        return found

    def mentions(self) -> DataFrame:
        """id, path, ref: every string value that is a valid id."""
        return per_row(self.entities.select("id", "content"), lambda r: [{"id": r["id"], "path": p, "ref": i} for p, i in documents.mentioned_ids(load(r["content"]))], "id string, path string, ref string")

    def broken_references(self) -> DataFrame:
        return self.references().join(self.entities.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", "ref")

    def relationships(self, wanted: DataFrame) -> DataFrame:
        """id, relationships, brokenReferences (sorted), error for rows of id."""
        wanted = wanted.select("id").distinct()
        some = Registry(self.entities.join(wanted, "id", "left_semi"))
        edges = some.references().join(self.entities.select(F.col("id").alias("ref"), F.lit(True).alias("there")), "ref", "left")
        lists = edges.groupBy("id").agg(F.array_sort(F.collect_set("ref")).alias("r"), F.array_sort(F.collect_set(F.when(F.col("there").isNull(), F.col("ref")))).alias("b"))
        there = self.entities.select("id", F.lit(True).alias("there"))
        none = F.array().cast("array<string>")
        return wanted.join(there, "id", "left").join(lists, "id", "left").select("id", F.coalesce("r", none).alias("relationships"), F.coalesce("b", none).alias("brokenReferences"), F.when(F.col("there").isNull(), F.concat(F.lit("Entity not found: "), "id")).alias("error"))

    def graph(self, wanted: DataFrame) -> DataFrame:
        """id and tree (JSON): what an id mentions, depth first; an id that was met before is not opened again."""

        def tree(row: dict) -> list[dict]:
            find, seen = _finder(row["env"]), set()

            def node(name: str) -> dict:
                out: dict = {"id": name}
                if name in seen:
                    return out
                seen.add(name)
                e = find(name)
                if e is None:
                    return out | {"errors": ["Entity not found"]}
                refs = {p: node(i) for p, i in documents.mentioned_ids(e.content) if i != name and not documents.is_meta_url(i)}
                if refs:
                    out["refs"] = refs
                if e.schema_id:
                    if not documents.is_meta_url(e.schema_id):
                        out["schema_id"] = node(e.schema_id)
                elif not e.is_schema:
                    out["errors"] = ["Schema not recognized"]
                return out

            return [{"id": row["key"], "tree": dumps(node(row["key"]))}]

        wanted = wanted.select("id").distinct()
        return per_row(self._with_env(wanted.select(F.col("id").alias("key")), wanted.select(F.col("id").alias("key"), "id"), mentioned=True), tree, "id string, tree string")

    # --- environments ---

    def environment(self, roots: DataFrame, mentioned: bool = False) -> DataFrame:
        """key and env: for rows of key and id, the documents of these ids and of all they need."""
        rows = self.entities.select("id", "schema_id", "is_schema", "content")
        front = known = written(roots.select("key", "id").distinct())
        found = None
        while True:
            hit = written(front.join(rows, "id").select("key", "id", "schema_id", "is_schema", "content"))
            found = hit if found is None else found.unionAll(hit)
            needs = per_row(hit.select("key", "schema_id", "content", F.lit(mentioned).alias("all")), _needs, "key string, id string")
            front = written(needs.distinct().join(known, ["key", "id"], "left_anti"))
            if front.isEmpty():
                return found.groupBy("key").agg(F.collect_list(F.struct("id", "schema_id", "is_schema", "content")).alias("env"))
            known = known.unionAll(front)

    def _with_env(self, rows: DataFrame, roots: DataFrame, mentioned: bool = False) -> DataFrame:
        return rows.join(self.environment(roots, mentioned), "key", "left")

    # --- validation ---

    def _instances(self, wanted: DataFrame) -> DataFrame:
        """id, entity, its schema's environment, and which of the ids that it mentions are registered."""
        asked = wanted.select("id").distinct().withColumn("key", lookup_key(F.col("id")))
        entity = self.entities.select(F.col("id").alias("key"), F.struct("id", "schema_id", "is_schema", "content").alias("entity"))
        rows = asked.join(entity, "key", "left").withColumn("schema", F.col("entity.schema_id"))
        needed = rows.filter("schema is not null").select(F.col("schema").alias("key"), F.col("schema").alias("id"))
        env = written(self.environment(needed))
        marked = env.filter(F.exists("env", lambda e: e["content"].contains(documents.REF))).select(F.col("key").alias("schema"))
        held = rows.join(marked, "schema", "left_semi").select("key", "entity.content")
        mentions = per_row(held, lambda r: [{"key": r["key"], "id": i} for i in {i for _, i in documents.mentioned_ids(load(r["content"]))}], "key string, id string")
        present = mentions.join(self.entities.select("id"), "id").groupBy("key").agg(F.collect_set("id").alias("present"))
        return rows.join(env.withColumnRenamed("key", "schema"), "schema", "left").join(present, "key", "left").select("id", "entity", "env", "present")

    def validate_instances(self, wanted: DataFrame) -> DataFrame:
        """id, ok, valid, error for rows of id."""

        def check(row: dict) -> list[dict]:
            present = set(row["present"] or ())
            e = documents.instance_error(row["id"], _entity(row["entity"]), _finder(row["env"]), present.__contains__)
            return [{"id": row["id"], "ok": e is None, "valid": e is None, "error": e or ""}]

        failed = lambda row, e: {"id": row["id"], "ok": False, "valid": False, "error": e}
        return per_row(self._instances(wanted), check, "id string, ok boolean, valid boolean, error string", failed)

    def _schemas(self, wanted: DataFrame, check: Callable[[str, Entity | None, documents.Find], str | None]) -> DataFrame:
        asked = wanted.select("id").distinct()
        chain = F.when(columns.valid_or_null(F.col("id")), columns.let(columns.segments(F.col("id")), lambda s: F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.concat(F.lit(ids.PREFIX), F.array_join(F.transform(F.slice(s, F.lit(1), n), lambda x: x["segment"]), "")))))
        roots = asked.select(F.col("id").alias("key"), F.explode(F.array_union(F.array("id"), F.coalesce(chain, F.array().cast("array<string>")))).alias("id"))

        def run(row: dict) -> list[dict]:
            find = _finder(row["env"])
            e = check(row["key"], find(row["key"]), find)
            return [{"id": row["key"], "ok": e is None, "error": e or ""}]

        failed = lambda row, e: {"id": row["key"], "ok": False, "error": e}
        return per_row(self._with_env(asked.select(F.col("id").alias("key")), roots), run, "id string, ok boolean, error string", failed)

    def validate_schemas(self, wanted: DataFrame) -> DataFrame:
        """id, ok, error: schemas against their parents and the traits of their chains."""
        return self._schemas(wanted, inheritance.schema_error)

    def validate_entity_traits(self, wanted: DataFrame) -> DataFrame:
        return self._schemas(wanted, inheritance.entity_traits_error)

    def validate_entities(self, wanted: DataFrame) -> DataFrame:
        """id, ok, error, entity_type: schemas as schemas, instances as instances."""
        asked = wanted.select("id").distinct()
        kind = self.entities.select("id", "is_schema")
        known = asked.join(kind, "id", "left")
        schema_error = lambda i, e, find: inheritance.entity_error(i, e, find)[1]
        schemas = self._schemas(known.filter("is_schema"), schema_error).withColumn("entity_type", F.lit("schema"))
        instances = self.validate_instances(known.filter("not is_schema")).select("id", "ok", "error", F.lit("instance").alias("entity_type"))
        missing = known.filter("is_schema is null").select("id", F.lit(False).alias("ok"), F.concat(F.lit("Entity not found: "), "id").alias("error"), F.lit("unknown").alias("entity_type"))
        return schemas.unionByName(instances).unionByName(missing)

    # --- versions ---

    @staticmethod
    def _spelled(ids_: DataFrame) -> DataFrame:
        """key and id: each key as it is and without outer spaces."""
        return ids_.select("key").distinct().select("key", F.explode(F.array_distinct(F.array("key", columns.strip(F.col("key"))))).alias("id"))

    def _pairs(self, pairs: DataFrame, a: str, b: str, instances: bool = False) -> DataFrame:
        """a, b and env: the documents that both need. What an id needs is gathered once, in however many pairs it is; of instances
        (a) it is what their schemas need."""
        both = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
        firsts, seconds = self._spelled(both.select(F.col("a").alias("key"))), self._spelled(both.select(F.col("b").alias("key")))
        doc = F.struct("id", "schema_id", "is_schema", "content")
        if instances:
            own = written(firsts.join(self.entities.select("id", "schema_id", "is_schema", "content"), "id"))
            named = own.filter("schema_id is not null").select(F.col("schema_id").alias("key")).distinct()
            env = written(self.environment(seconds.union(named.select("key", F.col("key").alias("id")))))
            of_schema = env.select(F.col("key").alias("schema_id"), "env")
            first = own.join(of_schema, "schema_id", "left").groupBy("key").agg(F.flatten(F.collect_list(F.array_append(F.coalesce("env", F.array().cast(of_schema.schema["env"].dataType)), doc))).alias("first"))
        else:
            env = written(self.environment(firsts.union(seconds)))
            first = env.select("key", F.col("env").alias("first"))
        rows = both.join(first.withColumnRenamed("key", "a"), "a", "left").join(env.select(F.col("key").alias("b"), F.col("env").alias("second")), "b", "left")
        none = F.array().cast(env.schema["env"].dataType)
        return rows.select("a", "b", F.concat(F.coalesce("first", none), F.coalesce("second", none)).alias("env"))

    def compatibility(self, pairs: DataFrame, flavor: str = "library") -> DataFrame:
        """A result for each pair of old and new."""
        failed = lambda r, e: compatibility.result(r["a"], r["b"], "unknown", [e], [e], [e], False)
        return per_row(self._pairs(pairs, "old", "new"), lambda r: [compatibility.check(r["a"], r["b"], _finder(r["env"]), flavor)], COMPATIBILITY, failed)

    def cast(self, pairs: DataFrame, flavor: str = "library") -> DataFrame:
        """A result for each pair of id and to; documents as JSON."""
        fn = casting.FLAVORS[flavor]

        def run(row: dict) -> list[dict]:
            out = fn(row["a"], row["b"], _finder(row["env"]))
            for k in ("result", "casted_entity"):
                if out.get(k) is not None:
                    out[k] = dumps(out[k])
            return [out]

        return per_row(self._pairs(pairs, "id", "to", instances=True), run, CASTS[flavor], lambda r, e: casting.failure(r["a"], r["b"], e, flavor))


def linted(docs: DataFrame, content: str = "content") -> DataFrame:
    """The rows with `lint`: the first reason against registering a schema strictly; null for others and if there is none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def check(row: dict) -> list[dict]:
        doc = load(row[content])
        return [row | {"lint": documents.schema_lint(doc) if extract(doc)[2] else None}]

    return per_row(docs, check, f"{fields}, lint string", lambda row, e: row | {"lint": e})


def ingested(docs: DataFrame, validate: bool = False, content: str = "content") -> DataFrame:
    """The rows with status and reason: 200 for what may be registered, 422 for what is refused, 400 for what has no id."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def check(row: dict) -> list[dict]:
        doc = load(row[content])
        own, schema_id, is_schema = extract(doc)
        status, reason = 200, None
        if validate and is_schema and (e := documents.schema_lint(doc)):
            status, reason = 422, e
        elif validate and not is_schema and not ids.is_valid(own) and not ids.is_valid(schema_id):
            status, reason = 422, "Instance must have a valid GTS ID or type field"
        elif not own:
            status, reason = 400, "Unable to extract GTS ID from entity"
        elif is_schema and (errors := documents.schema_ref_errors(doc)):
            status, reason = 422, f"x-gts-ref validation failed: {'; '.join(errors)}"
        return [row | {"status": status, "reason": reason}]

    return per_row(docs, check, f"{fields}, status int, reason string", lambda row, e: row | {"status": 422, "reason": e})
