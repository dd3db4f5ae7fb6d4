"""URL rules by a sort-merge range join, with DataFrame functions only.

A host's canonical key is its labels in reverse, each closed by a separator, so a rule's host and all its
subdomains are one interval of keys; rules nest or are disjoint. URLs and interval starts are sorted
together (range exchange, ties spread over partitions) and swept: every start carries the stack of the
intervals that are open at it, and a URL takes the stack of the last start before it and closes what ended.
What a partition inherits is a scan over one row for each partition, so no range of keys, hot host
or large rule set meets in one task. A second sweep of the same kind, over the rule's host followed by the
path, handles the rules' paths. Nothing is broadcast but one row for each partition.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no rule. Rules with
a null or empty host, or a null path, fit nothing. Of rules that fit the longest (host and path) wins;
of equal ones that with the longer host, then `block`. A URL without a rule gets the default verdict. Rows
repeat as in the input; null ids are kept; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from idloom.llm.common import table, written

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Closes a label; parts host and path. Both sort before all that URLs hold.
_LABEL, _PATH = "\x01", "\x00"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    known = at > 0
    host = F.when(known, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)))
    path = F.when(known, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), _LABEL), F.lit(_LABEL))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules given as (host, path, action) literals."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])
    return spark.range(1).select(F.inline(rows))


def _swept(points: DataFrame, starts: DataFrame) -> DataFrame:
    """points (rid, key, more) with `stack`: the keys of the open intervals, outermost first.
    starts: key, chain (array of the keys of this and all enclosing intervals)."""
    kept = [c for c in points.columns if c != "key"]
    events = points.withColumn("kind", F.lit(1)).unionByName(starts.select("key", "chain", F.lit(0).alias("kind")), allowMissingColumns=True)
    dealt = written(events.repartitionByRange("key", "kind", F.xxhash64("rid")).withColumn("part", F.spark_partition_id()))
    last = dealt.groupBy("part").agg(F.max_by("chain", F.when(F.col("kind") == 0, F.col("key"))).alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.last("own", ignorenulls=True).over(before).alias("carry"))
    within = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.join(F.broadcast(carried), "part")
        .withColumn("chain", F.coalesce(F.last("chain", ignorenulls=True).over(within), F.col("carry")))
        .filter(F.col("kind") == 1)
        .select(*kept, F.filter("chain", lambda k: F.col("key").startswith(k)).alias("stack"))
    )


def judged(urls: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The columns to keep, host, path, rule and verdict of every row."""
    host, path = host_and_path(F.col(url))
    # ids are given once and written with the rows, so that they are the same wherever they are read
    rows = written(urls.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path")).withColumn("rid", F.monotonically_increasing_id()))
    usable = rules.filter((F.col("host") != "") & F.col("path").isNotNull() & F.col("action").isNotNull()).select(ascii_lower(F.col("host")).alias("host"), "path", "action")
    usable = usable.withColumn("hkey", host_key(F.col("host"))).withColumn("pkey", F.concat("hkey", F.lit(_PATH), "path"))

    # the chain of a rule's host: those of its label prefixes that are rule hosts themselves
    hosts = usable.select("hkey").distinct()
    labels = F.split(F.expr("left(hkey, length(hkey) - 1)"), _LABEL, -1)
    prefixes = hosts.select("hkey", labels.alias("l")).select("hkey", F.explode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda n: F.concat(F.array_join(F.slice("l", 1, n), _LABEL), F.lit(_LABEL)))).alias("prefix"))
    chains = prefixes.join(hosts.withColumnRenamed("hkey", "prefix"), "prefix").groupBy(F.col("hkey").alias("key")).agg(F.array_sort(F.collect_list("prefix")).alias("chain"))
    # the chain of a rule's path: by the lengths of paths that its host has
    paths = usable.select("hkey", "pkey").distinct()
    sizes = paths.select("hkey", F.length("pkey").alias("n")).distinct()
    path_prefixes = paths.join(sizes, "hkey").filter(F.col("n") <= F.length("pkey")).select("hkey", "pkey", F.expr("left(pkey, n)").alias("prefix"))
    path_chains = path_prefixes.join(paths.select("hkey", F.col("pkey").alias("prefix")), ["hkey", "prefix"]).groupBy(F.col("pkey").alias("key")).agg(F.array_sort(F.collect_list("prefix")).alias("chain"))

    by_host = _swept(rows.select("rid", "path", host_key(F.col("host")).alias("key")), chains)
    met = by_host.select("rid", "path", F.explode("stack").alias("hkey"))
    by_path = _swept(met.select("rid", F.concat("hkey", F.lit(_PATH), "path").alias("key")), path_chains)
    # of one page's rules the longest counts; a rule's length is that of its key, less what separates
    name = F.concat("host", "path")
    best = usable.groupBy("pkey").agg(F.max("action").alias("action"), F.first("host").alias("host"), F.first("path").alias("path")).select("pkey", F.struct(F.length(name).alias("n"), F.length("host").alias("h"), F.col("action").alias("action"), name.alias("rule")).alias("r"))
    fits = by_path.select("rid", F.explode("stack").alias("pkey")).join(best, "pkey").groupBy("rid").agg(F.max("r").alias("r"))
    return rows.join(fits, "rid", "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.action"), F.lit(default)).alias("verdict")
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark), ["page_id"])


QUERIES = {"op9_url_filter": op9}
SQL = {
    "op9_url_filter": f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM split
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
}
