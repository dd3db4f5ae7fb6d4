"""The identifier functions by name, for SQL: id_is_valid, id_error, id_parse, id_uuid, id_is_type, id_match(id, pattern), doc_attribute(content, path).

id_is_valid, id_uuid and id_is_type are SQL expressions; the others go through Python in Arrow batches, as their logic is a program. In DataFrames
idloom.functions.columns does the same without Python.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from idloom.functions.columns import SEGMENT, jvm_pattern
from idloom.operators import documents
from idloom.operators import identifiers as ids


def _attribute(content: str, path: str) -> str | None:
    try:
        value = documents.attribute(json.loads(content), path)
    except ValueError:
        return None
    return None if value is documents.MISSING else documents.dumps(value)


def _segments(text: str) -> list[dict]:
    return [ids.record(s) for s in ids.parse(text)] if ids.error(text) is None else []


_STRIPPED = f"regexp_replace(t, r'{jvm_pattern(ids.EDGES)}', '')"
_FITS = f"""((length(t) <= {ids.MAX_LENGTH // 2} OR octet_length(encode({_STRIPPED}, 'UTF-16BE')) <= {2 * ids.MAX_LENGTH})
  AND (rlike(t, r'{jvm_pattern(ids.WHOLE)}') OR contains(t, '*') AND rlike(t, r'{jvm_pattern(ids.STARRED)}') AND t = lower(t)))"""
_UUID = f"""transform(array(sha1(concat(unhex('{ids.NAMESPACE.hex}'), encode(t, 'UTF-8')))), d -> concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), concat('5', substr(d, 14, 3)),
  concat(substr('89ab89ab89ab89ab', cast(conv(substr(d, 17, 1), 16, 10) AS int) + 1, 1), substr(d, 18, 3)), substr(d, 21, 12)))[0]"""
_EXPRESSIONS = {
    "id_is_valid": ("BOOLEAN", f"startswith(t, '{ids.PREFIX}') AND {_FITS}"),
    "id_is_type": ("BOOLEAN", "endswith(t, '~')"),
    "id_uuid": ("STRING", f"CASE WHEN t IS NULL THEN NULL WHEN {_FITS} THEN {_UUID} ELSE '' END"),
}
_ONE = {"id_error": (ids.error, "string"), "id_parse": (_segments, f"array<{SEGMENT}>")}
_TWO = {"id_match": (lambda c, p: ids.match(c, p)[0], "boolean"), "doc_attribute": (_attribute, "string")}


def register_all(spark: SparkSession) -> list[str]:
    """Registers the functions for this session; nulls give nulls."""

    def one(fn):
        def run(a: pd.Series) -> pd.Series:
            return a.map(lambda x: None if x is None else fn(x))

        return run

    def two(fn):
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return run

    for name, (kind, body) in _EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    for name, (fn, kind) in _ONE.items():
        spark.udf.register(name, pandas_udf(one(fn), kind))
    for name, (fn, kind) in _TWO.items():
        spark.udf.register(name, pandas_udf(two(fn), kind))
    return [*_EXPRESSIONS, *_ONE, *_TWO]
