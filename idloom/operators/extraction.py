"""Identities of JSON documents: which field names a document, which names its schema, and whether it is a schema.

Column expressions over a VARIANT; `extract` is the same in Python for document logic. Scalars and arrays have an empty id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idloom.functions import columns
from idloom.operators import identifiers as ids

# The fields, in order of precedence.
ID_FIELDS = ("$id", "$$id", "gtsId", "gtsIid", "gtsOid", "gtsI", "gts_id", "gts_oid", "gts_iid", "id")
SCHEMA_FIELDS = ("$schema", "$$schema", "gtsTid", "gtsType", "gtsT", "gts_t", "gts_tid", "gts_type", "type", "schema")
META = "json-schema.org"
_OWN = ("$id", "$$id")


def variant(content: Column) -> Column:
    return F.try_parse_json(content)


def path_of(key: str) -> str:
    return f"$['{key}']" if '"' in key else f'$["{key}"]'


def field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, path_of(key), "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def plain(text: Column) -> Column:
    """Without outer white space and the URI prefix; null if nothing is left."""
    return F.nullif(F.regexp_replace(columns.strip(text), f"^{ids.URI_PREFIX}", ""), F.lit(""))


def _texts(v: Column, names: tuple[str, ...]) -> Column:
    """Names and plain texts of the fields that have one, in order."""
    every = F.array(*[F.struct(F.lit(n).alias("field"), field(v, n).alias("v")) for n in names])
    texts = F.transform(F.filter(every, lambda x: kind(x["v"]) == "STRING"), lambda x: F.struct(x["field"].alias("field"), plain(x["v"].try_cast("string")).alias("value")))
    return F.filter(texts, lambda x: x["value"].isNotNull())


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _is_schema(v: Column) -> Column:
    """By the first of the two schema fields that isn't empty, zero, false or null."""
    true = lambda x: x.isNotNull() & (kind(x) != "VOID") & ~F.coalesce(x.try_cast("string").isin("", "0", "false"), F.lit(False))
    stated = F.get(F.filter(F.array(field(v, "$schema"), field(v, "$$schema")), true), F.lit(0))
    text = F.when(kind(stated) == "STRING", stated.try_cast("string"))
    return F.coalesce(text.rlike(rf"{META.replace('.', '[.]')}|\A(?:{ids.URI_PREFIX}|gts[.])"), F.lit(False))


def extracted(content: Column, schema_content: Column | None = None) -> Column:
    """id, schema_id, selected_entity_field, selected_schema_id_field, is_schema."""

    def of(x: Column) -> Column:
        entity, is_schema = x["entity"], x["is_schema"]
        own = entity["value"]
        chained = (F.instr(own, "~") > 0) & (F.regexp_replace(F.substr(own, F.instr(own, "~") + 1), r"~\z", "") != "") & columns.is_valid(own)
        head = F.when(chained, F.struct(entity["field"].alias("field"), F.regexp_extract(own, r"(?s)\A(.*~)[^~]+~?\z", 1).alias("value")))
        stated = _first(F.filter(x["named"], lambda f: f["field"].isin(*SCHEMA_FIELDS[:2])))
        valid = _first(F.filter(x["named"], lambda f: columns.is_valid(f["value"])))
        by_dollar = F.coalesce(entity["field"].isin(*_OWN), F.lit(False))
        # a schema's is that of its chain or what it states; an instance's, that of its chain (if it is no type) or the first valid one named
        schema = F.when(is_schema, F.coalesce(head, stated)).otherwise(F.coalesce(F.when(~own.endswith("~"), head), F.when(~by_dollar, valid)))
        return F.struct(F.coalesce(own, F.lit("")).alias("id"), schema.alias("schema"), entity["field"].alias("selected_entity_field"), is_schema.alias("is_schema"))

    def final(x: Column) -> Column:
        schema_id = x["schema"]["value"]
        if schema_content is not None:
            schema_id = F.coalesce(schema_id, columns.let(variant(schema_content), lambda w: _first(_texts(w, ID_FIELDS)))["value"])
        return F.struct(x["id"].alias("id"), schema_id.alias("schema_id"), x["selected_entity_field"].alias("selected_entity_field"), x["schema"]["field"].alias("selected_schema_id_field"), x["is_schema"].alias("is_schema"))

    facts = columns.let(variant(content), lambda v: F.struct(_first(_texts(v, ID_FIELDS)).alias("entity"), _texts(v, SCHEMA_FIELDS).alias("named"), _is_schema(v).alias("is_schema")))
    return columns.let(columns.let(facts, of), final)


def js_string(x: Column, depth: int = 3) -> Column:
    """A variant as text, as string concatenation in JSON's home language shows it; null and missing: empty."""
    k, d = kind(x), x.try_cast("double")
    size = F.abs(d)
    digits = F.regexp_replace(d.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    number = F.when((d == F.floor(d)) & (size < 1e18), F.floor(d).cast("bigint").cast("string")).when((size >= 1e-6) & (size < 1e18), digits).otherwise(F.lower(F.regexp_replace(d.cast("string"), r"(?:\.0)?E(\d)", "e+$1")))
    items = F.array_join(F.transform(x.try_cast("array<variant>"), lambda y: js_string(y, depth - 1)), ",") if depth else F.lit("")
    return F.coalesce(F.when(k.isin("STRING", "BOOLEAN"), x.try_cast("string")).when(k.startswith("ARRAY"), items).when(k.startswith("OBJECT"), "[object Object]").when(k == "VOID", "").otherwise(number), F.lit(""))


def filters_match(content: Column, filters: dict[str, str]) -> Column:
    """Whether top-level fields equal the texts; `*` asks for any value that isn't empty."""
    if not filters:
        return F.lit(True)
    none = F.lit(None)

    def of(v: Column) -> Column:
        rows = []
        for key, want in filters.items():
            unnamed = "'" in key and '"' in key  # no path can name such a key
            text = F.coalesce(F.get(F.from_json(content, "map<string,string>"), F.lit(key)), F.lit("")) if unnamed else none.cast("string")
            rows.append(F.struct(F.lit(want).alias("want"), (none.cast("variant") if unnamed else field(v, key)).alias("v"), text.alias("text")))
        fits = lambda f: columns.let(F.coalesce(f["text"], js_string(f["v"])), lambda have: F.when(f["want"] == "*", ~have.isin("", "null", "undefined")).otherwise(have == f["want"]))
        whole = F.coalesce(kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY"), F.lit(False))
        return whole & F.forall(F.array(*rows), fits)

    return columns.let(variant(content), of)


def extract(content: object) -> tuple[str, str | None, bool]:
    """id, schema_id and is_schema of a document in Python."""
    if not isinstance(content, dict):
        return "", None, False

    def texts(names):
        for n in names:
            if isinstance(content.get(n), str) and (t := ids.strip(content[n]).removeprefix(ids.URI_PREFIX)):
                yield n, t

    name, own = next(texts(ID_FIELDS), (None, ""))
    stated = content.get("$schema") or content.get("$$schema")
    schema = isinstance(stated, str) and (META in stated or stated.startswith((ids.URI_PREFIX, ids.PREFIX)))
    chain = own.removesuffix("~").rpartition("~")
    head = chain[0] + "~" if chain[1] and ids.is_valid(own) else None
    if schema:
        return own, head or next((t for _, t in texts(SCHEMA_FIELDS[:2])), None), True
    instance = head if not own.endswith("~") else None
    if name in _OWN:
        return own, instance, False
    return own, instance or next((t for _, t in texts(SCHEMA_FIELDS) if ids.is_valid(t)), None), False
