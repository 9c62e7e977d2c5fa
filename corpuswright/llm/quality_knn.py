"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a vector of terms: lower-cased words and runs of three bytes, both hashed, and shapes of
words (a repeat of the word before, capitals, symbols, length), each with a logarithmic weight and an
inverse document frequency learnt from the labelled sample. A singular
value decomposition of the sample's vectors gives the latent space. The sample's own vectors and
labels are broadcast; their number is bounded (``sample_rows``) and so is their size
(``sample_rows * dims`` numbers). Every document is projected in blocks of rows, its exact cosine
products with all labelled vectors are computed block by block, and its nearest ``neighbours`` vote,
each with its similarity to the power ``sharpness`` and the inverse share of its class in the sample.

Only the text is an input of a score. Labels are learnt from rows whose crc32 of the id modulo 4 is
not 2 and whose document is in the input; of these, those lowest by a hash of the id make the sample,
an equal number of each class as far as there are that many.

Defined results: a null or empty text has a zero vector and gets the sample's prior, as does any
document when no labelled row exists (0.5 then); a null doc_id is never held out (its crc32 is null)
and never learnt from; repeated rows have equal scores; an empty table gives an empty table. Columns
beside doc_id and text are left out of the query; the stage keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality_rules, scratch
from . import textkit as tk


@dataclass(frozen=True)
class Params:
    sample_rows: int = 4096
    terms: int = 1 << 11
    dims: int = 32
    neighbours: int = 15
    sharpness: float = 8.0
    threshold: float = 0.7
    block_rows: int = 512
    seed: int = 11


SHAPES = 64
_CAPITAL = tk.byte_set((0x41, 0x5A))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!", np.uint8))


def _shapes(raw: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The shape of each word, below SHAPES."""
    per_word = lambda table: np.add.reduceat(table[raw], starts) if len(starts) else np.zeros(0, np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    # reduceat runs on to the next word: what stands between words is white space, never counted
    capitals, symbols = per_word(_CAPITAL.astype(np.int64)) > 1, per_word(_SYMBOL.astype(np.int64)) > 0
    return again * 32 + capitals * 16 + symbols * 8 + np.minimum((ends - starts) // 2, 7)


def term_counts(texts: pa.Array, terms: int) -> np.ndarray:
    """Dense counts of terms: half of ``terms`` columns for words, half for runs of three bytes, then SHAPES."""
    half = terms // 2
    out = np.zeros((len(texts), terms + SHAPES), np.float32)
    for first, last, raw, offs in tk.blocks(texts):
        n = last - first
        low = tk.LOWER[raw]
        starts, ends, ptr = tk.split(low, offs, tk.SPACES)
        h, word_owner = tk.hash_ranges(low, starts, ends), tk.owners(ptr)
        words = (h % tk.U64(half)).astype(np.int64)
        out[first:last, :half] = np.bincount(word_owner * half + words, minlength=n * half).reshape(n, half)
        out[first:last, terms:] = np.bincount(word_owner * SHAPES + _shapes(raw, h, starts, ends, word_owner), minlength=n * SHAPES).reshape(n, SHAPES)
        if len(raw) > 2:
            code = raw[:-2].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[2:]
            code = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % half
            owner = np.repeat(np.arange(n), np.diff(offs))
            same = owner[:-2] == owner[2:]
            out[first:last, half:terms] = np.bincount(owner[:-2][same] * half + code[same], minlength=n * half).reshape(n, half)
    return out


@dataclass
class Model:
    """Projection of term weights, labelled vectors (unit length) and their vote weights for each class."""

    project: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    bad: np.ndarray
    params: Params
    prior: float

    def embed(self, texts: pa.Array) -> np.ndarray:
        return _unit(_weights(term_counts(texts, self.params.terms)) @ self.project)

    def scores(self, texts: pa.Array) -> np.ndarray:
        p, out = self.params, np.full(len(texts), self.prior)
        k = min(p.neighbours, len(self.vectors))
        for at in range(0, len(texts), p.block_rows):
            v = self.embed(texts.slice(at, p.block_rows))
            near = v @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** p.sharpness
            good, bad = (w * self.good[top]).sum(axis=1), (w * self.bad[top]).sum(axis=1)
            known = good + bad > 0
            out[at : at + len(v)][known] = good[known] / (good + bad)[known]
        return out


def _weights(counts: np.ndarray) -> np.ndarray:
    """Logarithmic counts, each kind of term scaled to unit length so that long texts weigh like short ones."""
    w = np.log1p(counts)
    half = (w.shape[1] - SHAPES) // 2
    for part in (w[:, :half], w[:, half : 2 * half], w[:, 2 * half :]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return w


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def fit_model(counts: np.ndarray, quality: np.ndarray, p: Params) -> Model | None:
    """Latent space and voters from the term counts of labelled texts; None without any text that has a word."""
    full = counts.any(axis=1)
    counts, quality = counts[full], quality[full]
    if not len(counts):
        return None
    w = _weights(counts)
    idf = np.log((1 + len(w)) / (1 + (w > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = w * idf
    # randomised range finder, then an exact decomposition of the small matrix
    rng = np.random.default_rng(p.seed)
    q = x @ rng.standard_normal((x.shape[1], min(p.dims + 16, len(x))), dtype=np.float32)
    for _ in range(2):
        q = x @ (x.T @ np.linalg.qr(q)[0])
    _, _, vt = np.linalg.svd(np.linalg.qr(q)[0].T @ x, full_matrices=False)
    vt = vt[: p.dims]
    project = (idf[:, None] * vt.T).astype(np.float32)
    vectors = _unit(w @ project)
    good, bad = quality == 1, quality != 1
    prior = float(good.mean())
    weight = lambda m: m / max(1, m.sum())
    return Model(project, vectors, weight(good), weight(bad), p, prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model | None:
    """A model from at most ``sample_rows`` labelled rows of ``docs`` outside the held-out ones."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    here = docs.select("doc_id").distinct()  # the limits of each class are filled with rows that docs has
    one = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).join(here, "doc_id", "left_semi")
    half = p.sample_rows // 2
    pick = lambda good, n: one.where((F.col("quality") == 1) == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    bad = pick(False, half)
    good = pick(True, half)
    chosen = quality_rules.one_row_each(docs, bad.unionByName(good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, p.block_rows):
                part = b.slice(at, p.block_rows)
                c = term_counts(part.column("text"), p.terms)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in c], pa.binary())], names=["doc_id", "quality", "counts"])

    # only counts come to the driver, whose size doesn't depend on the texts'
    counted = chosen.mapInArrow(run, "doc_id long, quality int, counts binary")
    rows = counted.orderBy("doc_id", "counts").limit(p.sample_rows).toArrow()
    counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.float32).reshape(len(rows), p.terms + SHAPES)
    return fit_model(counts, rows["quality"].to_numpy(), p)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted``, named with ``prefix``."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = m.scores(b.column("text")) if m else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((s >= (m.params.threshold if m else Params.threshold)).astype(np.int32))], names=[*keep, prefix + "score", prefix + "predicted"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents predicted to be good, with their own columns; without a model, all of them."""
    model = fit(docs, labels, p)
    if model is None:
        return docs
    prefix = scratch.free_prefix(docs.columns, "__knn_")
    return score(docs, model, tuple(docs.columns), prefix).where(F.col(prefix + "predicted") == 1).select(*docs.columns)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
