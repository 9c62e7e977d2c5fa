"""Facts of entities, their expansion into rows by templates and hash decisions, and conversations.

A fact is (entity, attribute, answer, gold); a template (kind, attribute, slot, text) has ``{name}`` where
the entity's name goes. Templates are a table of a few dozen rows and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import chance, slots_by_hash, stable_int
from ..shared import small

# Slots for training, validation and tests; shares of facts that get a further row.
TRAIN_SLOTS, VALIDATION_SLOT, TEST_SLOTS = (0, 1, 2, 3), 4, (5, 6)
OPEN_SHARE, MISS_SHARE, VALIDATION_SHARE, TEST_SHARE, CONTROL_SHARE, TWO_TURN_OPEN_SHARE = 0.35, 0.04, 0.08, 0.12, 0.5, 0.4
TERM_OPEN_SHARE, TERM_PHRASINGS = 0.25, 2


def explode_facts(entities: DataFrame, facts: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(entity columns, attribute, answer, values) of facts by attribute: (there is one, answer, values)."""
    rows = F.array_compact(F.array(*(F.when(there, F.struct(F.lit(a).alias("attribute"), answer.alias("answer"), values.alias("values"))) for a, (there, answer, values) in facts.items())))
    return entities.select("*", F.explode(rows).alias("f")).select(*entities.columns, "f.*")


def _key() -> Column:
    return F.concat_ws("|", "entity", "attribute")


def _row(split: str | Column, slot: Column, ending: str, open_book: bool, group: Column, when: Column) -> Column:
    slot = slot.cast("int")
    row_id = F.concat_ws("|", _key(), slot.cast("string"), *([F.lit(ending)] if ending else []))
    split = split if isinstance(split, Column) else F.lit(split)
    return F.when(when, F.struct(split.alias("split"), row_id.alias("id"), slot.alias("slot"), F.lit(open_book).alias("open_book"), group.alias("group")))


def _test_slot() -> Column:
    return TEST_SLOTS[0] + stable_int("test-slot", _key()) % 2


def drawn(term: bool = False) -> Column:
    """What a fact's rows are drawn by and use more than once: struct(slots, skip, open) of numbers by hash.

    As a column of its own (cf. ``tx.once``) it is made once for all rows of the fact.
    """
    key, seen = _key(), F.col("group") == "seen"
    slots = F.when(F.col("group") == "rag_only", slots_by_hash(TRAIN_SLOTS, "rag", key))
    if term:
        slots = slots.when(seen, slots_by_hash(TRAIN_SLOTS, "nm-slot", key))
    skip = F.lit(None).cast("bigint") if term else F.when(seen, stable_int("skip", key) % 4)
    return F.struct(slots.alias("slots"), skip.alias("skip"), F.when(seen, chance(TERM_OPEN_SHARE if term else OPEN_SHARE, "open", key)).alias("open"))


def seen_rows(term: bool = False, by: Column | None = None) -> list[Column]:
    """Rows of a fact of a seen entity: closed, open or missed, validation and test."""
    key, seen = _key(), F.col("group") == "seen"
    closed = F.lit("seen_closed")
    by = drawn(term) if by is None else by
    if term:
        slots = by["slots"]
        train = [_row("train", slots[i], "", False, F.col("group"), seen) for i in range(TERM_PHRASINGS)]
        extra = [_row("train", slots[0], "open", True, F.col("group"), seen & by["open"])]
    else:
        skip = by["skip"]
        train = [_row("train", F.lit(s), "", False, F.col("group"), seen & (skip != s)) for s in TRAIN_SLOTS]
        opened = by["open"]
        extra = [
            _row("train", stable_int("open-slot", key) % 4, "open", True, F.col("group"), seen & opened),
            _row("train", stable_int("miss-slot", key) % 4, "miss", True, F.col("group"), seen & ~opened & chance(MISS_SHARE, "miss", key)),
        ]
    later = [_row("validation", F.lit(VALIDATION_SLOT), "", False, closed, seen & chance(VALIDATION_SHARE, "val", key)), _row("test", _test_slot(), "", False, closed, seen & chance(TEST_SHARE, "test", key))]
    return train + extra + later


def rag_only_rows(term: bool = False, by: Column | None = None) -> list[Column]:
    """Open rows of a fact that is only trained with its entry at hand: two slots, or one for terms."""
    slots = (drawn(term) if by is None else by)["slots"]
    return [_row("train", slots[i], "open", True, F.col("group"), F.col("group") == "rag_only") for i in range(1 if term else 2)]


def held_out_rows(term: bool = False, inferable: tuple[str, ...] = ()) -> list[Column]:
    """Rows of a fact that is never trained: open always; closed as a control, or if it can be inferred."""
    held = F.col("group").startswith("heldout")
    split = F.when(F.col("group") == "heldout_val", "validation").otherwise("test")
    slot = F.when(F.col("group") == "heldout_val", F.lit(VALIDATION_SLOT)).otherwise(_test_slot())
    if term:
        closed = _row(split, slot, "closed", False, F.lit("unseen_closed"), held & F.col("attribute").isin(*inferable))
    else:
        closed = _row(split, slot, "closed", False, F.lit("heldout_closed"), (F.col("group") == "heldout_test") & chance(CONTROL_SHARE, "control", _key()))
    return [_row(split, slot, "open", True, F.lit("heldout_open"), held), closed]


def expand(facts: DataFrame, rows: list[Column], templates: DataFrame, name: str = "name") -> DataFrame:
    """(split, id, group, open_book, entity, attribute, slot, question, answer) of facts with a group."""
    made = facts.select("entity", "kind", name, "attribute", "answer", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("entity", "kind", name, "attribute", "answer", "r.*")
    asked = made.join(small(templates), ["kind", "attribute", "slot"])
    return asked.select("split", "id", "group", "open_book", "entity", "attribute", "slot", F.replace("text", F.lit("{name}"), F.col(name)).alias("question"), "answer")


def reverse(entities: DataFrame, value: str, name: str, order: str) -> DataFrame:
    """(key, first, names) of each value, whatever its case: the names that have it, in order."""
    grouped = entities.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(F.lower(value).alias("key"))
    return grouped.agg(F.min_by(value, order).alias("first"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))).alias("x")).select("key", "first", F.transform("x", lambda y: y["n"]).alias("names"))


def two_turns(facts: DataFrame, templates: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """(id, entity, messages) for entities with two facts or more: the two first by hash, one after the other.

    ``follow_ups`` are (attribute, follow); each fact's first question has the first training slot by hash.
    """
    ranked = facts.join(small(follow_ups), "attribute").groupBy("entity", "kind", "name").agg(F.array_sort(F.collect_list(F.struct(stable_int("turn", F.col("entity"), F.col("attribute")).alias("h"), "attribute", "answer", "follow"))).alias("f"))
    pairs = ranked.where(F.size("f") >= 2).select("entity", "kind", "name", F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))
    keyed = pairs.withColumn("slot", slots_by_hash(TRAIN_SLOTS, "turn-slot", F.col("entity"))[0]).withColumn("attribute", F.col("a.attribute"))
    asked = keyed.join(small(templates), ["kind", "attribute", "slot"])
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(message("user", F.replace("text", F.lit("{name}"), F.col("name"))), message("assistant", F.col("a.answer")), message("user", F.col("b.follow")), message("assistant", F.col("b.answer")))
    row_id = F.concat(F.col("entity"), F.lit("|"), F.col("a.attribute"), F.lit(">"), F.col("b.attribute"))
    return asked.select(row_id.alias("id"), "entity", messages.alias("messages"), chance(TWO_TURN_OPEN_SHARE, "multi-open", row_id).alias("open_too"))
