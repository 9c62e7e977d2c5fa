"""Grouped summaries, intervals, paired tests and resumable logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

METRICS = ("correct", "score", "token_f1", "rouge_l", "answer_words")
CONTROL, GENERALIZATION = "heldout_closed", ("heldout_open", "unseen_closed")


def summarize(scored: DataFrame, metrics: tuple[str, ...] = METRICS, digits: int = 4) -> DataFrame:
    """Means by group, group and attribute, group and source, overall without the control and for unseen groups.

    One pass: the levels of (model, group, attribute, source) are grouping sets; the two overall rows
    filter within the aggregate.
    """
    sets = [["model", "group"], ["model", "group", "attribute"], ["model", "group", "source"], ["model"]]
    keys = ("model", "group", "attribute", "source")
    level = F.grouping_id(*keys).alias("level")
    control, unseen = F.col("__g") != CONTROL, F.col("__g").isin(*GENERALIZATION)
    means = []
    for m in metrics:
        value = F.col(m).cast("double")
        means += [F.avg(value).alias(m), F.avg(F.when(control, value)).alias(f"{m}_known"), F.avg(F.when(unseen, value)).alias(f"{m}_unseen")]
    counts = [F.count("*").alias("n"), F.count(F.when(control, 1)).alias("n_known"), F.count(F.when(unseen, 1)).alias("n_unseen")]
    rows = scored.withColumn("__g", F.col("group")).groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, keys)).agg(level, *counts, *means)
    whole = F.col("group").isNull()
    kinds = F.when(whole, F.array(F.lit("known"), F.lit("unseen"))).otherwise(F.array(F.when(F.col("attribute").isNotNull(), "attribute").when(F.col("source").isNotNull(), "source").otherwise("group")))
    spread = rows.select("*", F.explode(kinds).alias("scope"))
    pick = lambda c: F.when(F.col("scope") == "known", F.col(f"{c}_known")).when(F.col("scope") == "unseen", F.col(f"{c}_unseen")).otherwise(F.col(c)).alias(c)
    return spread.select("scope", *keys, pick("n"), *(F.round(pick(m), digits).alias(m) for m in metrics)).where("n > 0")


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): the 95% interval of k in n; 0 to 0 of none."""
    p = k / F.greatest(n, F.lit(1))
    d = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    none = n == 0
    return F.struct(F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)).alias("low"), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + half)).alias("high"))


#: Of small numbers: what the logarithm of the factorial has beyond Stirling's formula.
_STIRLING_ERRORS = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]


def _stirling_error(n: Column) -> Column:
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (n * n)) / (n * n)) / (n * n)) / n
    return F.when(n < 16, F.element_at(F.array(*map(F.lit, _STIRLING_ERRORS)), (n + 1).cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x, without cancellation where the two are close."""

    def near(v: Column) -> Column:
        powers = F.lit(0.0)
        for j in range(8, 0, -1):
            powers = (powers + 1.0 / (2 * j + 1)) * v * v
        return (x - mean) * v + 2 * x * v * powers

    v = (x - mean) / (x + mean)
    return F.when(F.abs(v) < 0.1, near(v)).otherwise(x * F.log(x / mean) + mean - x)


def _half_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of n fair coins, 0 < 2k + 1 < n: the probability of k times the continued fraction of the incomplete beta function."""
    a, b = n - k, k + 1
    state = F.struct(F.lit(1.0).alias("c"), (1 / (1 - (a + b) * 0.5 / (a + 1))).alias("d"), (1 / (1 - (a + b) * 0.5 / (a + 1))).alias("h"), F.lit(False).alias("done"))

    def term(s: Column, coefficient: Column) -> Column:
        d, c = 1 / (1 + coefficient * s["d"]), 1 + coefficient / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"), (F.abs(d * c - 1) < 1e-15).alias("done"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * 0.5 / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 1 + 2 * m))
        one = lambda x: F.transform(F.array(x), lambda y: term(y, odd))[0]
        return F.when(s["done"], s).otherwise(one(term(s, even)))

    steps = F.transform(F.sequence(F.lit(1), (4 * F.pow(n, F.lit(0.4))).cast("int") + 8), lambda m: m.cast("double"))
    fraction = F.aggregate(steps, state, step, lambda s: s["h"])
    log_p = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n / 2) - _deviance(n - k, n / 2)
    return F.sqrt(n / (2 * math.pi * k * (n - k))) * F.exp(log_p) / 2 * fraction


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p of discordant counts of any size; the steps grow slower than the root of their sum."""
    sides = F.struct((only_a + only_b).cast("double").alias("n"), F.least(only_a, only_b).cast("double").alias("k"))

    def p(x: Column) -> Column:
        n, k = x["n"], x["k"]
        return F.when(2 * k + 1 >= n, 1.0).when(k == 0, 2 * F.exp(-n * math.log(2.0))).otherwise(F.least(F.lit(1.0), 2 * _half_tail(n, k)))

    return F.transform(F.array(sides), p)[0]


def paired(results: DataFrame, key: str, group: str, a: str, b: str) -> DataFrame:
    """Per group, over keys that both models answered: counts, shares, intervals, discordant counts and p."""
    sides = results.where(F.col("model").isin(a, b)).groupBy(key, group).agg(F.max(F.when(F.col("model") == a, F.col("correct").cast("int"))).alias("x"), F.max(F.when(F.col("model") == b, F.col("correct").cast("int"))).alias("y"))
    both = sides.where("x IS NOT NULL AND y IS NOT NULL").groupBy(group).agg(F.count("*").alias("n"), F.sum("x").alias("k_a"), F.sum("y").alias("k_b"), F.sum(F.when(F.expr("x > y"), 1).otherwise(0)).alias("only_a"), F.sum(F.when(F.expr("y > x"), 1).otherwise(0)).alias("only_b"))
    return both.withColumns({"ci_a": wilson(F.col("k_a"), F.col("n")), "ci_b": wilson(F.col("k_b"), F.col("n")), "p": mcnemar(F.col("only_a"), F.col("only_b"))})


def todo(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have not been worked on."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def last_wins(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest record of each key; a partial aggregate."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in log.columns if c not in keys)), order).alias("r")).select(*keys, "r.*")


def first_of_group(rows: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def rate(log: DataFrame, by: str, order: list[str], amount: str, time: Column) -> DataFrame:
    """Adds ``rate``: the change of a running amount over that of time since the record before."""
    w = Window.partitionBy(by).orderBy(*order)
    seconds = time.cast("double")
    return log.withColumn("rate", (F.col(amount) - F.lag(amount).over(w)) / F.nullif(seconds - F.lag(seconds).over(w), F.lit(0.0)))


def group_of(row_id: Column) -> Column:
    """The evaluation group that a row's id tells."""
    closed = F.when(row_id.startswith("nm-") | row_id.startswith("sat-"), "unseen_closed").otherwise("heldout_closed")
    return (
        F.when(row_id.startswith("concept-"), "concepts")
        .when(row_id.startswith("safety-"), "safety")
        .when(row_id.endswith("|open"), "heldout_open")
        .when(row_id.endswith("|closed"), closed)
        .otherwise("seen_closed")
    )


def answered_by_all(results: DataFrame, key: str, models: tuple[str, ...]) -> DataFrame:
    """Results of keys that every model has answered."""
    full = results.where(F.col("model").isin(*models)).groupBy(key).agg(F.countDistinct("model").alias("n")).where(F.col("n") == len(models))
    return results.join(full.select(key), key, "left_semi")


def rescored(rows: DataFrame, log: DataFrame, keys: list[str], metrics: Column, order: str) -> DataFrame:
    """The latest record of each key with its metrics made anew from the rows' columns."""
    latest = last_wins(log, [*keys, "model"], order).drop("metrics")
    return latest.join(rows, keys).withColumn("metrics", metrics)


def run_summary(log: DataFrame) -> DataFrame:
    """One row of a training log: the middle speed (the upper one of an even number), and step and value of the least evaluation loss."""
    one = log.withColumn("__run", F.lit(0))
    middle = ranks.at_shares(one, ["__run"], "tokens_per_second", {"speed": 0.5})
    best = log.agg(F.min("eval_loss").alias("eval_loss"), F.min_by("step", F.when(F.col("eval_loss").isNotNull(), F.col("eval_loss"))).alias("step"))
    return best.join(middle.select("speed"), how="left").select("speed", "eval_loss", "step")


def weighted_loss(log: DataFrame, by: list[str], loss: str, tokens: str) -> DataFrame:
    """Loss for each token and its perplexity, of summed losses."""
    nll = F.sum(loss) / F.sum(tokens)
    return log.groupBy(*by).agg(nll.alias("nll"), F.exp(nll).alias("perplexity"))


def token_stats(examples: DataFrame, by: list[str], ids: str, supervised: str) -> DataFrame:
    """Rows, tokens, supervised tokens and the longest example."""
    return examples.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(ids).alias("tokens"), F.sum(supervised).alias("supervised"), F.max(ids).alias("longest"))
