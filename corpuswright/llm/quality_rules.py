"""Quality rules: rule statistics of whole texts, judged by fixed limits and by an isolation forest.

The statistics of a text are counts over all of its bytes. Two fixed limits (too few words, too
many repeated word windows) decide first. For the rest, an isolation forest on ratios of the
statistics gives each document the mean depth at which random splits isolate it; documents that
are isolated early are anomalous. Every labelled row that passes the fixed limits takes part in the fit:
its ratios are what trees draw their rows from (a forest's trees are grown on small draws by definition, ``subsample`` rows
each, lowest by a hash of id and tree among all labelled rows), and the limit for the score is calibrated on the labels of
all of them, by counts of scores (see ``calibrate``).

Defined results: null or empty text has all counts zero, fails the base rule and is not kept;
null ids stay null; repeated rows each get their own, equal result; an empty table gives an empty
table. Without any labelled row, or with no good one, nothing is rejected by the forest. The counts
are independent of other columns, and columns of the same names in the input are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from . import textkit as tk

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")
BASE = COUNTS[:5]
#: Few and telling: each further feature gives good documents more ways to be outliers.
FEATURES = ("word_length", "symbols", "distinct")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_NEWLINE = tk.byte_set((10, 10))


@dataclass(frozen=True)
class Params:
    min_words: int = 50
    max_repeat_percent: int = 50
    trees: int = 100
    subsample: int = 64
    #: None: every labelled row; a number only for a user who wants a quick look
    sample_rows: int | None = None
    max_good_loss: float = 0.005
    seed: int = 7


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _duplicated(keys: np.ndarray, keep: str | bool) -> np.ndarray:
    """Flags of the entries whose key occurs before ("first") or more than once (False)."""
    return pd.Series(keys).duplicated(keep=keep).to_numpy()


def text_counts(texts: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for first, last, buf, offs in tk.blocks(texts):
        n = last - first
        starts, ends, ptr = tk.split(buf, offs, tk.SPACES)
        owner = tk.owners(ptr)
        word, firsts = tk.distinct(buf, starts, ends)
        size = max(1, len(firsts))
        block = out[first:last]
        block[:, 0] = np.diff(ptr)
        begins = (buf & 0xC0) != 0x80
        block[:, 1] = _per_text(begins & ~tk.SPACES[buf], offs)
        block[:, 2] = _per_text(_SYMBOL[buf], offs)
        # lines with a word, without their separators' runs: equal bytes, line ends apart
        ls, le, lptr = tk.split(buf, offs, _NEWLINE)
        words_in = np.searchsorted(starts, le) - np.searchsorted(starts, ls)
        full = words_in > 0
        line_owner = tk.owners(lptr)[full]
        line_keys = line_owner * (len(ls) + 1) + tk.distinct(buf, ls[full], le[full])[0]
        later = _duplicated(line_keys, "first")
        block[:, 3] = np.bincount(line_owner[later], minlength=n)
        # words inside any window of three words that the text holds twice or more
        m = max(0, len(word) - 2)
        at = np.flatnonzero(owner[:m] == owner[2:]) if m else np.zeros(0, np.int64)
        pairs, _ = pd.factorize(word[at] * size + word[at + 1])
        windows, window_list = pd.factorize(pairs * size + word[at + 2])
        hit = at[_duplicated(owner[at] * (len(window_list) + 1) + windows, False)]
        covered = np.zeros(len(word), bool)
        for j in range(3):
            covered[hit + j] = True
        block[:, 4] = np.bincount(owner[covered], minlength=n)
        block[:, 5] = np.bincount(owner[~_duplicated(owner * size + word, "first")], minlength=n)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios of the counts, a column for each of FEATURES."""
    c = counts.astype(np.float64)
    words = np.maximum(c[:, 0], 1)
    return np.column_stack([c[:, 1] / words, c[:, 2] / words, np.log1p(c[:, 5]) / np.log1p(words)])


def base_failed(counts: np.ndarray, p: Params) -> np.ndarray:
    return (counts[:, 0] < p.min_words) | (100 * counts[:, 4] > p.max_repeat_percent * counts[:, 0])


@dataclass
class Forest:
    """Trees as arrays: [tree, node] of feature (-1 at a leaf), split value and path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    depth: int
    scale: float
    limit: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), from 0 (deep, common) to 1 (isolated at once)."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, path in zip(self.feature, self.value, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= value[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.scale)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_forest(rows_in: np.ndarray | list[np.ndarray], p: Params) -> Forest:
    """Random splits of each tree's own draw of rows; of a matrix, draws are made here."""
    rng = np.random.default_rng(p.seed)
    draws = rows_in if isinstance(rows_in, list) else [rows_in[rng.choice(len(rows_in), min(p.subsample, len(rows_in)), replace=False)] for _ in range(p.trees)]
    size = max(map(len, draws))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = 2 ** (depth + 1) - 1
    feature, value, path = np.full((p.trees, nodes), -1), np.zeros((p.trees, nodes)), np.zeros((p.trees, nodes))
    for t, drawn in enumerate(draws):
        todo = [(0, 0, drawn)]
        while todo:
            node, level, rows = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            varied = np.flatnonzero(high > low)
            if level == depth or len(rows) <= 1 or not len(varied):
                path[t, node] = level + _expected(len(rows))
                continue
            f = varied[rng.integers(len(varied))]
            v = rng.uniform(low[f], high[f])
            feature[t, node], value[t, node] = f, v
            right = rows[:, f] >= v
            todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return Forest(feature, value, path, depth, max(_expected(size), 1e-9), np.inf)


def calibrate(forest: Forest, x: np.ndarray, quality: np.ndarray, p: Params) -> Forest:
    """Set the score limit from labels.

    Of the limits above which at most ``max_good_loss`` of the good rows lie, it is the one that
    rejects the most other rows, and of equal ones the highest, half way to the next score.
    """
    scores = forest.scores(x)
    good, bad = np.sort(scores[quality == 1]), np.sort(scores[quality != 1])
    allowed = np.unique(np.append(good[max(0, int(np.ceil(len(good) * (1 - p.max_good_loss))) - 1) :], good[-1:]))
    rejected = len(bad) - np.searchsorted(bad, allowed, side="right")
    limit = allowed[len(allowed) - 1 - int(np.argmax(rejected[::-1]))]
    above = bad[bad > limit]
    forest.limit = float((limit + above[0]) / 2 if len(above) and not ((good > limit) & (good < above[0])).any() else limit)
    return forest


def score_limit(scored: DataFrame, p: Params) -> float:
    """What ``calibrate`` sets, from a table (quality, score) of any size: by numbers of rows above each distinct score."""
    good = F.col("quality") == 1
    counted = scratch.cut(scored.groupBy("score").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")), "rule-scores")
    total = counted.agg(F.sum("good")).first()[0]
    spare = total - max(1, int(np.ceil(total * (1 - p.max_good_loss))))  # good rows that may lie above
    # running counts from the highest score down, by ranges of scores
    ranged = scratch.cut(counted.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "rule-ranges")
    sums = {r["part"]: r for r in ranged.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()}
    before, g, b = [], 0, 0
    for part in sorted(sums):
        before.append((part, g, b))
        g, b = g + sums[part]["good"], b + sums[part]["bad"]
    above = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.join(F.broadcast(scored.sparkSession.createDataFrame(before, "part int, g long, b long")), "part")
    run = run.select("score", "good", "bad", *((F.coalesce(F.sum(c).over(above), F.lit(0)) + F.col(c[0])).alias(f"{c}_above") for c in ("good", "bad")))
    allowed = run.where((F.col("good") > 0) & (F.col("good_above") <= spare))
    limit = allowed.agg(F.max_by("score", F.struct("bad_above", "score")).alias("limit")).first()["limit"]
    next_up = counted.where(F.col("score") > limit).agg(F.min(F.when(F.col("bad") > 0, F.col("score"))).alias("bad"), F.min(F.when(F.col("good") > 0, F.col("score"))).alias("good")).first()
    clear = next_up["bad"] is not None and (next_up["good"] is None or next_up["good"] >= next_up["bad"])
    return float((limit + next_up["bad"]) / 2 if clear else limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """(text, quality) of all labelled rows of ``docs``, or of ``sample_rows`` of them, those lowest by a hash of the id."""
    return _labelled(docs, labels, p).select("text", "quality")


def _labelled(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if p.sample_rows is None:
        return _one_row_of(docs, marked)
    return one_row_each(docs, marked.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_rows))


def one_row_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, quality, text) of the few chosen ids: of an id's rows, the one whose text is lowest by its hash."""
    return _one_row_of(docs, F.broadcast(chosen))


def _one_row_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    least = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return least.select("doc_id", "quality", "least.text")


def _ratios(p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, quality, *FEATURES) of the rows that pass the fixed limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = text_counts(b.column("text"))
            passed = pa.array(np.flatnonzero(~base_failed(c, p)))
            x = features(c)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(passed), b.column("quality").cast(pa.int32()).take(passed), *(pa.array(x[:, j]).take(passed) for j in range(len(FEATURES)))], names=["doc_id", "quality", *FEATURES])

    return run


def _drawn(rows: DataFrame, p: Params) -> list[np.ndarray]:
    """Each tree's draw: of all rows the ``subsample`` lowest by a hash of id and tree; each task sends on its own lowest only."""
    trees = rows.select(*FEATURES, F.xxhash64("doc_id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))) for _ in range(p.trees)]
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            for t, (held, rows_held) in enumerate(best):
                h = tk.mix(ids ^ np.uint64((p.seed * 1_000_003 + t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)
                new = np.flatnonzero(h < held.max()) if len(held) == p.subsample else np.arange(len(h))
                hashes = np.append(held, h[new])
                least = np.argsort(hashes, kind="stable")[: p.subsample]
                best[t] = hashes[least], np.vstack([rows_held, x[new]])[least]
        tree = np.repeat(np.arange(p.trees), [len(h) for h, _ in best])
        hashes, kept = np.concatenate([h for h, _ in best]), np.vstack([x for _, x in best])
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(hashes), *(pa.array(kept[:, j]) for j in range(len(FEATURES)))], names=["tree", "h", *FEATURES])

    own = trees.mapInArrow(run, "tree long, h long, " + ", ".join(f"{f} double" for f in FEATURES))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("h", *FEATURES))
    got = own.withColumn("n", place).where(F.col("n") <= p.subsample).orderBy("tree", "n").toPandas()  # trees x subsample rows
    return [g[list(FEATURES)].to_numpy() for _, g in got.groupby("tree")]


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Forest | None:
    """A forest calibrated on all labelled rows, or None if no row is labelled as good."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.cut(_labelled(docs, labels, p).mapInArrow(_ratios(p), f"doc_id {kind}, quality int, " + ", ".join(f"{f} double" for f in FEATURES)), "rule-ratios")
    if rows.where("quality = 1").isEmpty():
        return None
    forest = fit_forest(_drawn(rows, p), p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(forest.scores(x))], names=["quality", "score"])

    forest.limit = score_limit(rows.mapInArrow(score, "quality int, score double"), p)
    return forest


def judge(docs: DataFrame, forest: Forest | None, p: Params = Params(), keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs`` with base counts, ``base_failed``, ``score`` and ``kept`` (named with ``prefix``)."""
    names = [*BASE, "base_failed", "score", "kept"]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(prefix + c, T.LongType() if c in BASE else T.DoubleType() if c == "score" else T.BooleanType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = text_counts(b.column("text"))
            failed = base_failed(counts, p)
            score = forest.scores(features(counts)) if forest else np.zeros(len(counts))
            kept = ~failed & (score <= (forest.limit if forest else np.inf))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(counts[:, j]) for j in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(kept)], names=[*keep, *(prefix + c for c in names)])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that pass, with their own columns."""
    forest = fit(docs, labels, p)
    prefix = scratch.free_prefix(docs.columns, "__rule_")
    return judge(docs, forest, p, tuple(docs.columns), prefix).where(F.col(prefix + "kept")).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels)).drop("score")
