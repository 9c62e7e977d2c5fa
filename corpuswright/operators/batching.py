"""Batches under a budget of padded tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_int


def padded(n: Column, multiple: int = 8) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("long")


def pools(examples: DataFrame, budget: int, pool_batches: int = 64, seed: str = "0") -> DataFrame:
    """Adds ``pool``: about ``pool_batches`` batches' worth of examples (id, length), dealt by hash."""
    total = examples.agg(F.count("*").alias("n"), F.sum("length").alias("t")).first()
    size = max(1, pool_batches * budget // max(1, (total.t or 0) // max(1, total.n)))
    count = max(1, -(-total.n // size))
    return examples.withColumn("pool", (stable_int(seed, F.col("id")) % count).cast("int"))


def _starts(lengths: Column, budget: int, multiple: int) -> Column:
    """Where batches begin in an array of lengths: a fold whose state is (next place, batches so far, longest, held)."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("longest"), F.lit(0).cast("long").alias("held"))
    def step(s: Column, n: Column) -> Column:
        size = padded(n, multiple)
        longest = F.greatest(s["longest"], size)
        opens = (s["held"] == 0) | (longest * (s["held"] + 1) > budget)
        starts = F.when(opens, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"])
        return F.struct((s["at"] + 1).alias("at"), starts.alias("starts"), F.when(opens, size).otherwise(longest).alias("longest"), F.when(opens, F.lit(1).cast("long")).otherwise(s["held"] + 1).alias("held"))

    return F.aggregate(lengths, state, step, lambda s: s["starts"])


def pack(examples: DataFrame, budget: int, multiple: int = 8, pool_batches: int = 64, seed: str = "0") -> DataFrame:
    """(pool, batch, id, length): each pool in order of length, cut where padding would exceed the budget.

    Where a batch ends depends on where the last one ended, so a pool, which has a bounded number of examples, is one array; a fold over
    its lengths finds where batches begin, and each batch is a slice. Longer examples than the budget raise.
    """
    dealt = pools(examples, budget, pool_batches, seed).select("pool", "id", F.col("length").cast("long").alias("length"))
    fits = F.when(padded(F.col("length"), multiple) <= budget, F.col("length")).otherwise(
        F.raise_error(F.concat(F.lit("an example of "), padded(F.col("length"), multiple).cast("string"), F.lit(f" padded tokens exceeds the budget of {budget}"))).cast("long")
    )
    sorted_ = dealt.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct(fits.alias("length"), "id"))).alias("rows"))
    # generated once, not where it is used
    cut = sorted_.select("pool", "rows", F.explode(F.array(_starts(F.transform("rows", lambda r: r["length"]), budget, multiple))).alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("rows")))
    slices = F.transform("starts", lambda at, i: F.slice("rows", at + 1, F.element_at(ends, i + 1) - at))
    batches = cut.select("pool", F.posexplode(slices).alias("batch", "rows"))
    return batches.select("pool", "batch", F.explode("rows").alias("r")).select("pool", "batch", "r.id", "r.length")


def costs(batches: DataFrame, multiple: int = 8) -> DataFrame:
    """(pool, batch, size, longest, cost) of packed batches."""
    rows = batches.groupBy("pool", "batch").agg(F.count("*").alias("size"), F.max("length").alias("longest"))
    return rows.withColumn("cost", padded(F.col("longest"), multiple) * F.col("size"))


def worst(batch_costs: DataFrame) -> DataFrame:
    """The batch with the most padded tokens and that with the longest example (one row if it is one)."""
    key = F.struct((-F.col("pool")).alias("p"), (-F.col("batch")).alias("b"))
    row = F.struct("pool", "batch", "size", "longest", "cost")
    picked = batch_costs.agg(F.max_by(row, F.struct("cost", key.alias("k"))).alias("a"), F.max_by(row, F.struct("longest", key.alias("k"))).alias("b"))
    return picked.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("x.*")


def epoch_order(batch_costs: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Adds ``place``: the largest batch first, the others in the order of a hash of the epoch.

    Batches are counted by slices of the hash, and placed within their slice: no task holds them all.
    """
    first = batch_costs.agg(F.max_by(F.struct("pool", "batch"), F.struct("cost", (-F.col("pool")).alias("p"), (-F.col("batch")).alias("b"))).alias("f"))
    h = stable_int(str(seed), str(epoch), F.col("pool"), F.col("batch"))
    marked = batch_costs.join(F.broadcast(first)).withColumn("__h", F.when((F.col("pool") == F.col("f.pool")) & (F.col("batch") == F.col("f.batch")), -1).otherwise(h)).drop("f")
    sliced = marked.withColumn("__s", F.when(F.col("__h") < 0, -1).otherwise(F.floor(F.col("__h") / (1 << 36))).cast("int"))
    before = F.sum("n").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))  # 4097 slices at most
    starts = sliced.groupBy("__s").agg(F.count("*").alias("n")).select("__s", F.coalesce(before, F.lit(0)).alias("__from"))
    within = F.row_number().over(Window.partitionBy("__s").orderBy("__h", "pool", "batch")) - 1
    return sliced.withColumn("place", within).join(F.broadcast(starts), "__s").withColumn("place", (F.col("place") + F.col("__from")).cast("long")).drop("__s", "__h", "__from")


def mask_prompt(prompt: Column, answer: Column, ignored: int = -100) -> Column:
    """Labels: the prompt's positions ignored, then the answer's ids."""
    return F.concat(F.array_repeat(F.lit(ignored), F.size(prompt)), answer)


def pad_right(ids: Column, to: Column, value: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), to - F.size(ids)).cast("int")))


def collate(ids: Column, labels: Column, to: Column, pad: int, ignored: int = -100) -> Column:
    """struct(input_ids, labels, attention_mask), padded on the right; padding is neither attended to nor learned."""
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(F.lit(0), to - F.size(ids)).cast("int")))
    return F.struct(pad_right(ids, to, pad).alias("input_ids"), pad_right(labels, to, ignored).alias("labels"), mask.alias("attention_mask"))


def fitting(examples: DataFrame, ids: str, most: int) -> DataFrame:
    """Examples whose ids are no more than ``most``."""
    return examples.where(F.size(ids) <= most)


def by_length(examples: DataFrame, length: str, id_: str) -> DataFrame:
    """Examples sorted by length: ranges of lengths, each sorted."""
    return examples.repartitionByRange(length, id_).sortWithinPartitions(length, id_)
