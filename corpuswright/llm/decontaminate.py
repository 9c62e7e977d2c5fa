"""Benchmark decontamination with SQL functions alone.

Words are the maximal runs of letters, digits and non-ASCII characters of the text with A-Z
lower-cased. A benchmark item's windows are its runs of ``window`` consecutive words, or all its
words if it has fewer. A document's word is hit if it lies inside an occurrence of a window.

Scanning has two steps, the same for benchmarks of any size. First only every
``window - anchor + 1``-th run of ``anchor`` words is looked up among the windows' own runs of
that length; any occurrence of a window holds one of these runs at whatever offset, so nothing is
missed. These runs are a Bloom filter that is a constant of the plan, so documents are sifted where they are
read, without a shuffle; its size is bounded (``FILTER_BITS``), and a filter that is too small for its runs only lets more
documents through. Documents with such a run (few) then have all their windows looked up by their text in the relation of
benchmark windows, which verifies hits exactly. Spark broadcasts that relation if its size, as measured, allows, and shuffles both sides
if not. Equal texts are looked up once.

Defined results: a null or empty text has no words, no hits and is not contaminated; benchmark
items that have a null id or no word are left out; an id with several texts has the windows of all;
null document ids stay null; repeated rows have equal results; an empty documents table gives an
empty table, an empty benchmark no hits. Columns beside the ids and texts are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .bloom import Level, holds, make_level

WINDOW = 13
ANCHOR = 5
#: Of the filters of all window lengths together.
FILTER_BITS = 1 << 28
#: A document is contaminated if a word in this many is hit, or more.
SHARE = 20
OWN = "__own_"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _NOT_WORD), lambda w: w != "")


def fixed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once a row: the optimiser doesn't copy it to where it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _run(at: str, n: int | str) -> str:
    return f"array_join(slice(words, {at} + 1, {n}), ' ')"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, n, items): distinct windows, their number of words and the sorted ids of their items."""
    items = fixed(benchmark.where("item_id IS NOT NULL").select("item_id", "text"), words_of(F.col("text")), "words").where("size(words) > 0")
    n = f"least(size(words), {window})"
    grams = items.select("item_id", F.expr(n).alias("n"), F.explode(F.expr(f"transform(sequence(0, size(words) - {n}), i -> {_run('i', n)})")).alias("gram"))
    return grams.groupBy("gram", "n").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _sieve(windows: DataFrame, anchor: int, most_bits: int) -> Column:
    """Has ``words`` a run that a window may lie around?"""
    out = F.lit(False)
    lengths = windows.agg(F.sort_array(F.collect_set("n"))).first()[0]  # as many as a window has words, at most
    for n in lengths:
        k = min(anchor, n)
        own = windows.where(F.col("n") == n).select(F.split("gram", " ").alias("words"))
        runs = scratch.cut(own.select(F.explode(F.expr(f"transform(sequence(0, {n - k}), i -> {_run('i', k)})")).alias("k")).distinct(), "anchors")
        level = make_level(runs, runs.count(), 16, n, most_bits // len(lengths))
        # the runs as elements of an array, so that each is made once
        strided = F.expr(f"CASE WHEN size(words) >= {n} THEN transform(sequence(0, (size(words) - {k}) div {n - k + 1}), i -> {_run(f'i * {n - k + 1}', k)}) ELSE cast(array() as array<string>) END")
        out = out | _any_held(strided, level, n)
    return out


def _any_held(runs: Column, level: Level, n: int) -> Column:
    return F.exists(runs, lambda r: holds(level, r, n))


def _key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep: tuple[str, ...] = ("doc_id",), most_bits: int = FILTER_BITS) -> DataFrame:
    """Columns ``keep`` (as ``__own_<name>``), ``n_words`` and ``hits``: (at, n, items) of each window that occurs, by position.

    What the sieve lets through is told apart from the rest in one pass, whose result is kept in the shared folder.
    """
    windows = scratch.cut(item_windows(benchmark, window), "windows")
    columns = [F.col(c).alias(OWN + c) for c in keep]
    worded = fixed(docs.select(*columns, F.col("text").alias("__text")), words_of(F.col("__text")), "words")
    sifted = fixed(worded, _sieve(windows, anchor, most_bits), "__some")
    some = lambda c: F.when(F.col("__some"), c)
    held = scratch.cut(sifted.select(*(OWN + c for c in keep), F.size("words").cast("long").alias("n_words"), some(F.col("words")).alias("words"), some(_key(F.col("__text"))).alias("__key")), "sifted")
    free = held.where("__key IS NULL").drop("__key", "words").withColumn("hits", F.expr(_NO_HITS))
    met = held.where("__key IS NOT NULL").drop("words").join(_hits(held.where("__key IS NOT NULL"), windows), "__key", "left").drop("__key")
    return free.unionByName(met.withColumn("hits", F.coalesce("hits", F.expr(_NO_HITS))))


def _hits(asked: DataFrame, windows: DataFrame) -> DataFrame:
    """(__key, hits) of texts (__key, words) with windows, each text once."""
    texts = asked.groupBy("__key").agg(F.first("words").alias("words"))
    lengths = windows.agg(F.sort_array(F.collect_set("n"))).first()[0]
    grams = f"flatten(transform(filter(cast(array({', '.join(map(str, lengths))}) as array<int>), n -> n <= size(words)), n -> transform(sequence(0, size(words) - n), i -> struct(i AS at, n AS n, {_run('i', 'n')} AS gram))))"
    spread = texts.select("__key", F.explode(F.expr(grams)).alias("g")).select("__key", "g.*")
    return spread.join(windows, ["gram", "n"]).groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("at", "n", "items"))).alias("hits"))


def own(df: DataFrame) -> list[Column]:
    """The columns that ``scan`` kept, under their own names."""
    return [F.col(c).alias(c.removeprefix(OWN)) for c in df.columns if c.startswith(OWN)]


_NO_HITS = "cast(array() as array<struct<at:int,n:int,items:array<bigint>>>)"


def judge(scanned: DataFrame, share: int = SHARE) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to the rows of ``scan``."""
    cover = """aggregate(hits, struct(0 AS stop, 0L AS n), (a, h) -> struct(greatest(a.stop, h.at + h.n) AS stop, a.n + greatest(0, h.at + h.n - greatest(a.stop, h.at)) AS n), a -> a.n)"""
    items = "array_sort(transform(array_distinct(flatten(transform(hits, h -> h.items))), i -> cast(i as string)))"
    rows = fixed(scanned, F.expr(f"struct({cover} AS n_hit, {items} AS ids)"), "__r")
    n_hit = F.col("__r.n_hit")
    return rows.select(
        *(c for c in scanned.columns if c not in ("hits", "words")),
        n_hit.cast("long").alias("n_hit"),
        F.size("__r.ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("__r.ids", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents that are not contaminated, with their own columns: an anti-join with the contaminated texts' keys, which are few."""
    judged = judge(scan(docs.select(_key(F.col("text")).alias("key"), "text"), benchmark, keep=("key",)), share)
    bad = scratch.cut(judged.where("contaminated").select(F.col(OWN + "key").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, _key(docs["text"]) == bad["__bad"], "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and text of all documents, without the words that are hit; what stands between words stays."""
    scanned = scan(docs, benchmark, keep=("doc_id", "text"))
    hit = "exists(hits, h -> i >= h.at AND i < h.at + h.n)"
    between, words = F.split("text", _ANY_CASE), F.regexp_extract_all("text", F.lit(f"({_ANY_CASE})"), 1)
    split = fixed(fixed(scanned.select(*own(scanned), "hits"), words, "own"), between, "gaps")
    built = F.expr(f"concat(gaps[0], array_join(transform(sequence(0, size(own) - 1), i -> concat(CASE WHEN {hit} THEN '' ELSE own[i] END, gaps[i + 1])), ''))")
    return split.select("doc_id", F.when(F.size("hits") > 0, built).otherwise(F.col("text")).alias("text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return judged.select(*own(judged), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS gram FROM b WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM g),
x AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM d, l WHERE len(w) >= n),
h AS (SELECT r, pos, x.n, item_id FROM x JOIN g ON x.gram = g.gram AND x.n = g.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::varchar AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
