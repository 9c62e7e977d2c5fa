"""Splits, caps, first-wins and best-wins dedup, twin merges and leakage checks.

Checks return the rows that violate a rule; an empty result passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import entity_group, stable_int
from ..shared import cut, small

# Most rows kept of each (split, group, source); others are not capped.
CAPS = (
    ("validation", "seen_closed", "ak", 180), ("validation", "seen_closed", "ag", 90),
    ("validation", "seen_closed", "nm", 120), ("validation", "seen_closed", "sat", 120),
    ("validation", "heldout_open", "nm", 60), ("validation", "heldout_open", "sat", 60),
    ("validation", "unseen_closed", "nm", 60), ("validation", "unseen_closed", "sat", 60),
    ("test", "seen_closed", "ak", 330), ("test", "seen_closed", "ag", 170),
    ("test", "seen_closed", "nm", 250), ("test", "seen_closed", "sat", 250),
    ("test", "heldout_open", "ak", 220), ("test", "heldout_open", "ag", 100),
    ("test", "heldout_open", "nm", 200), ("test", "heldout_open", "sat", 200),
    ("test", "heldout_closed", "ak", 120), ("test", "heldout_closed", "ag", 60),
    ("test", "unseen_closed", "nm", 250), ("test", "unseen_closed", "sat", 300),
)


def keep_first(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each non-empty key; a partial aggregate, no sort. Ties need an order that is unique."""
    keyed = df.withColumn("__key", key).where(F.coalesce(F.col("__key"), F.lit("")) != "")
    return keyed.groupBy("__key").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def keep_best(df: DataFrame, key: Column, score: Column, index: str) -> DataFrame:
    """The row of each key with the highest score, the earliest of equal ones; a partial aggregate, no sort."""
    row = F.struct(*df.columns)
    best = df.withColumn("__key", key).groupBy("__key").agg(F.max_by(row, F.struct(score, -F.col(index))).alias("r"))
    return best.select("r.*")


def first_indices(df: DataFrame, key: Column, index: str) -> DataFrame:
    """The indices (a column as the index) of the rows that ``keep_first`` may keep by this order: the smallest one of each non-empty key.

    Only key and index are read and hashed, cf. ``best_indices``.
    """
    keyed = df.select(key.alias("__key"), index).where(F.coalesce(F.col("__key"), F.lit("")) != "")
    return keyed.groupBy("__key").agg(F.min(index).alias(index)).select(index).distinct()


def best_indices(df: DataFrame, key: Column, score: Column, index: str) -> DataFrame:
    """The indices (a column as the index) of the rows that ``keep_best`` may keep: for each key the first one of the highest score.

    Only key, score and index are read and hashed, so a large table is narrowed by these before its other columns are made.
    """
    first = df.select(key.alias("__key"), score.alias("__score"), index).groupBy("__key", "__score").agg(F.min(index).alias("__first"))
    return first.groupBy("__key").agg(F.max_by("__first", "__score").alias(index)).select(index).distinct()


def merge_twins(df: DataFrame, key: str, index: str, filled: list[str]) -> DataFrame:
    """One row of each key, the first by index; its empty ``filled`` columns take the next value there is."""
    others = [c for c in df.columns if c not in (key, index, *filled)]
    first = F.min_by(F.struct(*others), index).alias("__first")
    fill = [F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(index))), F.lit("")).alias(c) for c in filled]
    return df.groupBy(key).agg(F.min(index).alias(index), first, *fill).select(key, index, *(F.col("__first")[c].alias(c) for c in others), *filled)


def informativeness(*columns: str) -> Column:
    """How many of the columns are not empty."""
    return sum((F.coalesce(F.col(c), F.lit("")) != "").cast("int") for c in columns)


def capped(rows: DataFrame, caps: DataFrame) -> DataFrame:
    """Rows in hash order up to the caps (split, group, source, most); rows (split, id, group, source, ...) without a cap all stay.

    Only groups with a cap are ranked, and each task drops what exceeds the largest cap before the shuffle; the caps are a
    few dozen rows by definition, which is checked before they are broadcast.
    """
    keys = ["split", "group", "source"]
    largest, count = caps.agg(F.max("most"), F.count("*")).first()
    few = F.broadcast(caps) if count <= 10_000 else caps
    order = Window.partitionBy(*keys).orderBy(stable_int("cap", F.col("split"), F.col("id")), "id")
    ranked = rows.join(few, keys).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= (largest or 0)).where("__n <= most")
    return rows.join(few.select(*keys), keys, "left_anti").unionByName(ranked.select(*rows.columns))


def caps_table(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(CAPS, "split string, `group` string, source string, most long")


def name_groups(df: DataFrame, name: str, namespace: str = "namaste:") -> DataFrame:
    """Adds ``group`` by the spelling-insensitive name, so that spelling twins share a split."""
    return df.withColumn("group", entity_group(F.concat(F.lit(namespace), tx.group_key(F.col(name)))))


def by_prefix(df: DataFrame, id_: str, code: str, index: str) -> DataFrame:
    """Adds ``parent``: the first row whose code is this one's up to the last dot, or else the last hyphen.

    Prefixes are few where rows are many: each distinct one finds its row, and only then rows meet their prefixes' rows.
    """
    prefixes = [F.when(F.instr(code, mark) > 0, F.expr(f"substring(`{code}`, 1, char_length(`{code}`) - instr(reverse(`{code}`), '{mark}'))")) for mark in (".", "-")]
    wanted = df.select(F.explode(F.array_compact(F.array(*prefixes))).alias("__c")).distinct()
    first = df.groupBy(F.col(code).alias("__c")).agg(F.min_by(id_, index).alias("__p"))
    side = small(cut(first.join(wanted, "__c", "left_semi"), "prefixes"))
    out = df
    for n, prefix in enumerate(prefixes):
        own = side.select(F.col("__c").alias(f"__c{n}"), F.col("__p").alias(f"__p{n}"))
        out = out.withColumn(f"__k{n}", prefix).join(own, F.col(f"__k{n}") == F.col(f"__c{n}"), "left")
    not_self = [F.when(F.col(f"__p{n}") != F.col(id_), F.col(f"__p{n}")) for n in (0, 1)]
    return out.withColumn("parent", F.coalesce(*not_self)).drop("__k0", "__k1", "__c0", "__c1", "__p0", "__p1")


def by_section(df: DataFrame, id_: str, keys: tuple[str, str], parent_key: str, index: str, usable: Column) -> DataFrame:
    """Adds ``parent``: the last row with (section, own key) = (section, parent key), if usable and not itself; distinct keys first, cf. ``by_prefix``."""
    section, own = keys
    wanted = df.select(F.col(section).alias("__s"), F.col(parent_key).alias("__o")).distinct()
    last = df.groupBy(F.col(section).alias("__s"), F.col(own).alias("__o")).agg(F.max_by(F.struct(F.col(id_).alias("id"), usable.alias("ok")), index).alias("p"))
    side = small(cut(last.join(wanted, ["__s", "__o"], "left_semi"), "sections"))
    joined = df.join(side, (F.col(section) == F.col("__s")) & (F.col(parent_key) == F.col("__o")), "left")
    return joined.withColumn("parent", F.when(F.col("p.ok") & (F.col("p.id") != F.col(id_)), F.col("p.id"))).drop("__s", "__o", "p")


def with_fallback(df: DataFrame, refs: DataFrame, first: str, second: str) -> DataFrame:
    """Adds ``reference``: that of the first key if not empty, else of the second; of repeated keys (key, idx, ref) the last counts."""
    last = refs.groupBy("key").agg(F.max_by("ref", "idx").alias("ref"))
    a, b = (last.select(F.col("key").alias(f"__{n}"), F.col("ref").alias(f"__r{n}")) for n in "ab")
    out = df.join(a, F.col(first) == F.col("__a"), "left").join(b, F.col(second) == F.col("__b"), "left")
    return out.withColumn("reference", F.coalesce(F.expr("nullif(__ra, '')"), F.expr("nullif(__rb, '')"), F.lit(""))).drop("__a", "__b", "__ra", "__rb")


def question_overlap(rows: DataFrame) -> DataFrame:
    """Evaluation rows whose normalised question is also a training question (split, id, group, question)."""
    keyed = rows.withColumn("__q", tx.question_key(F.col("question")))
    train = keyed.where("split = 'train'").select("__q").distinct()
    return keyed.where("split <> 'train' AND `group` <> 'safety'").join(train, "__q", "left_semi").select("split", "id")


def entity_overlap(rows: DataFrame) -> DataFrame:
    """Entities of unseen evaluation rows that occur in training."""
    unseen = rows.where("split <> 'train' AND `group` IN ('heldout_open', 'unseen_closed', 'heldout_closed')").select("entity").distinct()
    return unseen.join(rows.where("split = 'train'").select("entity").distinct(), "entity", "left_semi")


def twin_overlap(rows: DataFrame) -> DataFrame:
    """Unseen evaluation rows whose entity has the name, but for spelling, of a trained one."""
    keyed = rows.withColumn("__k", tx.group_key(F.col("name")))
    trained = keyed.where("split = 'train'").select("__k").distinct()
    return keyed.where("split <> 'train' AND `group` IN ('heldout_open', 'unseen_closed')").join(trained, "__k", "left_semi").select("split", "id", "entity")


def context_overlap(contexts: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training contexts (query_id, card_id) that are held out (card_id)."""
    return contexts.join(held_out, "card_id", "left_semi")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct non-empty values of a that b hasn't."""
    return a.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(key).distinct().join(b.select(key), key, "left_anti")


def is_covered(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (covered): has b every value of a?"""
    return set_difference(a, b, key).limit(1).agg((F.count("*") == 0).alias("covered"))
