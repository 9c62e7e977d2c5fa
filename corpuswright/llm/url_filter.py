"""Exact URL filtering with a cascade of Bloom filters, on the JVM alone.

A rule is a host, for itself and its subdomains, and a prefix of the path. Every URL has candidate
keys: the suffixes of its host with as many labels as some rule's, with the prefixes of its path that are as long as some
rule's. A URL fits a rule exactly if the rule is one of its keys, so filtering is membership of
keys in the list.

The cascade answers membership exactly over the key universe of the corpus, that is, all candidate
keys of all its URLs. Level 1 encodes the listed keys; level 2 the keys of the universe that level 1
takes for listed without reason; level 3 the listed keys that level 2 takes for such, and so on until
a level has no false positive. A key's verdict is that of the first level that doesn't hold it. The first level lets
through a false key in ``2 ** FIRST_BITS``, each later one every second, so level 2 has ``universe / 2 ** FIRST_BITS``
keys and from there on each level halves.

The allow and the block list have a cascade each; one pass over the corpus finds the false positives of both first levels,
and only those are shuffled. They stay in tables; no list and no false positive is collected, and neither is capped. What comes to the
driver, and goes back into the plan as a constant, are the levels' bits: some 35 for a listed key, 1.5 for a false positive.
Judging is a scan without join or shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; of
several fitting rules the longest (host and path together) wins, of equally long ones that with
the longer host; of rules with one host and path in a table block wins, in a tuple the last; null ids stay null, repeated rows
have equal results, an empty table an empty one, and so has a table without rules no rule. Columns beside page_id and url are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .bloom import Level, holds, make_level

FIRST_BITS = 24

#: The contract's rules: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    return _lower(F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path."""
    named = pages.select("page_id", F.col("url").alias("__url"))
    return named.select("page_id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))


def with_keys(urls: DataFrame, labels: list[int], path_lengths: list[int]) -> DataFrame:
    """Adds ``keys``: candidate keys of (host, path), longest first, of equally long ones the longer host first.

    Only suffixes of so many labels and prefixes of such lengths as rules have.
    """
    listed = lambda x: f"array({', '.join(map(str, x)) or 'cast(null as int)'})"
    parts = "split(host, '[.]')"
    suffixes = f"transform(filter({listed(labels)}, n -> n <= size({parts})), n -> array_join(slice({parts}, -n, n), '.'))"
    prefixes = f"transform(filter({listed(path_lengths)}, n -> n <= char_length(path)), n -> substring(path, 1, n))"
    each = f"flatten(transform({suffixes}, h -> transform({prefixes}, p -> struct(-char_length(h) - char_length(p) AS a, -char_length(h) AS b, concat(h, p) AS key))))"
    return urls.withColumn("keys", F.expr(f"transform(array_sort(CASE WHEN host = '' THEN cast(array() as array<struct<a:int,b:int,key:string>>) ELSE {each} END), x -> x.key)"))


def member(levels: list[Level], key: Column) -> Column:
    """Is the key listed? The first level that doesn't hold it decides; the last one's yes stands."""
    out = F.lit(len(levels) % 2 == 1)
    for n in reversed(range(len(levels))):
        out = F.when(~holds(levels[n], key, n), n % 2 == 1).otherwise(out)
    return out


def cascades(listed: dict[str, DataFrame], universe: DataFrame, first_bits: int = FIRST_BITS) -> dict[str, list[Level]]:
    """For each list (distinct keys in column ``k``) levels that tell its keys from all other keys of ``universe``."""
    counts = {v: df.count() for v, df in listed.items()}
    levels = {v: [make_level(df, counts[v], first_bits, 0)] if counts[v] else [] for v, df in listed.items()}
    names = [v for v in listed if counts[v]]
    if not names:
        return levels
    flags = [holds(levels[v][0], F.col("k"), 0).alias(f"in_{v}") for v in names]
    passing = scratch.cut(universe.select("k", *flags).where(" OR ".join(f"in_{v}" for v in names)).distinct(), "passing")
    for v in names:
        sides = [listed[v], scratch.cut(passing.where(f"in_{v}").select("k").join(listed[v], "k", "left_anti"), "false")]
        while count := sides[1].count():
            n = len(levels[v])
            levels[v].append(make_level(sides[1], count, 1, n))
            sides = [sides[1], scratch.cut(sides[0].where(holds(levels[v][n], F.col("k"), n)), "false")]
    return levels


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] | DataFrame) -> DataFrame:
    """(k, verdict, labels, length) of rules (verdict, host, path), one for each host and path; hosts in lower case."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(v, h, p) for (h, p), v in {(h, p): v for v, h, p in rules}.items()], "verdict string, host string, path string")
    keyed = rules.select("verdict", _lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> ''")
    own = keyed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return own.select(F.concat("host", "path").alias("k"), "verdict", F.size(F.split("host", "[.]")).alias("labels"), F.char_length("path").alias("length"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page; rules are (verdict, host, path)."""
    listed = scratch.cut(rule_table(pages.sparkSession, rules), "rules")
    shape = listed.agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("length"))).first()  # as many as hosts have labels and paths characters
    keyed = with_keys(parsed(pages), *shape)
    levels = cascades({v: listed.where(F.col("verdict") == v).select("k") for v in ("block", "allow")}, keyed.select(F.explode("keys").alias("k")))
    told = lambda k: F.when(member(levels["block"], k), "block").when(member(levels["allow"], k), "allow")
    fits = F.filter(F.transform("keys", lambda k: F.struct(k.alias("key"), told(k).alias("verdict"))), lambda x: x["verdict"].isNotNull())
    found = keyed.withColumn("fit", F.try_element_at(fits, F.lit(1)))
    return found.select("page_id", "host", "path", F.col("fit.key").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP6_SQL = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(verdict, rule_host, rule_path)),
f AS (SELECT p.*, rule_host || rule_path AS rule, verdict,
  row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
