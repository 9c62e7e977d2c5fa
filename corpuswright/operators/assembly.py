"""Conversation rows from facts and curated files: split, phrased, opened with entries, capped and filtered.

A drafted row is (split, id, question, answer, history, source, entity, name, attribute, group, slot, open_book,
gold, gold_id, salt). ``rows`` makes the final ones of them, with messages and meta data. Random choices of the
published builder are choices by hash here: they depend on names, not on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import prompts, scoring
from ..functions import text as tx
from ..functions.hashing import chance, slots_by_hash, stable_int
from ..shared import cut, small
from . import facts as fx
from . import mentions, retrieval, splits
from .entities import gold

# Terms have their own rules; what can be inferred of an unseen one; the slot asked without diacritics.
TERM_KINDS, INFERABLE, PLAIN_SLOT = ("nm", "sat"), ("nm_english", "sat_meaning"), 6
#: Concepts that are small talk: they are trained, but no entries of the knowledge base. A corpus names its own.
CONVERSATIONAL = ("greeting",)
MESSAGE = "array<struct<role:string,content:string>>"


def _no_history() -> Column:
    return F.array().cast(MESSAGE)


def _asked(drafted: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds the question by (kind, attribute, slot); terms in the last slot without diacritics."""
    shown = F.when(F.col("kind").isin(*TERM_KINDS) & (F.col("slot") == PLAIN_SLOT), tx.unmarked(F.col("name"))).otherwise(F.col("name"))
    return drafted.join(small(templates), ["kind", "attribute", "slot"]).withColumn("question", F.replace("text", F.lit("{name}"), shown))


def fact_rows(facts: DataFrame, templates: DataFrame) -> DataFrame:
    """Drafts of all facts (cf. ``entities.facts``) by their group; templates (kind, attribute, slot, text) are a small table."""
    out = None
    for term in (False, True):
        kinds = F.col("kind").isin(*TERM_KINDS) if term else ~F.col("kind").isin(*TERM_KINDS)
        by = F.col("__by")
        made = fx.seen_rows(term, by) + fx.rag_only_rows(term, by) + fx.held_out_rows(term, INFERABLE)
        spread = tx.once(facts.where(kinds), fx.drawn(term), "__by").select("entity", "kind", "name", "attribute", "answer", "gold", F.explode(F.array_compact(F.array(*made))).alias("r")).select("entity", "kind", "name", "attribute", "answer", "gold", "r.*")
        out = spread if out is None else out.unionByName(spread)
    key = F.concat_ws("|", "entity", "attribute")
    gold_id = F.when(F.col("open_book"), F.col("entity"))
    asked = _asked(out, templates)
    return asked.select("split", "id", "question", "answer", _no_history().alias("history"), F.col("kind").alias("source"), "entity", "name", "attribute", "group", "slot", "open_book", "gold", gold_id.alias("gold_id"), key.alias("salt"))


def _lookups(named: DataFrame, templates: DataFrame, kind: str, attribute: str, prefix: str, term: bool) -> DataFrame:
    """Drafts of reverse lookups (key, entity, shown, answer, values) of seen entities."""
    spread = named.withColumns({"kind": F.lit(kind), "attribute": F.lit(attribute), "name": F.col("shown"), "gold": gold("phrase", F.col("values")), "group": F.lit("seen")})
    key = F.concat(F.lit(prefix), F.col("key"))
    if term:
        slots = slots_by_hash(fx.TRAIN_SLOTS, "nm-slot", key)
        train = F.transform(F.slice(slots, 1, fx.TERM_PHRASINGS), lambda s: F.struct(F.lit("train").alias("split"), s.alias("slot"), F.lit("seen").alias("g")))
    else:
        train = F.transform(F.filter(F.array(*map(F.lit, fx.TRAIN_SLOTS)), lambda s: s != stable_int("skip", key) % 4), lambda s: F.struct(F.lit("train").alias("split"), s.alias("slot"), F.lit("seen").alias("g")))
    later = [("test", (fx.TEST_SLOTS[0] + stable_int("test-slot", key) % 2).cast("int"), chance(fx.TEST_SHARE, "test", key))]
    if not term:
        later.append(("validation", F.lit(fx.VALIDATION_SLOT), chance(fx.VALIDATION_SHARE, "val", key)))
    more = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(s).alias("split"), slot.alias("slot"), F.lit("seen_closed").alias("g"))) for s, slot, when in later)))
    rows = spread.select("*", F.explode(F.concat(train, more)).alias("r")).select("entity", "kind", "name", "attribute", "answer", "gold", "key", "r.split", "r.slot", F.col("r.g").alias("group"))
    asked = rows.join(small(templates), ["kind", "attribute", "slot"])
    return asked.select(
        "split", F.concat(F.lit(prefix), F.col("key"), F.lit("|"), F.col("slot").cast("string")).alias("id"), F.replace("text", F.lit("{name}"), F.col("name")).alias("question"), "answer",
        _no_history().alias("history"), F.col("kind").alias("source"), "entity", "name", "attribute", "group", "slot", F.lit(False).alias("open_book"), "gold", F.lit(None).cast("string").alias("gold_id"), F.lit("").alias("salt"),
    )


def modern_lookups(conditions: DataFrame, templates: DataFrame) -> DataFrame:
    """From the first modern alternative, whatever its case, to all seen conditions that have it."""
    seen = conditions.where("`group` = 'seen'").withColumn("first_modern", F.trim(F.split("modern_equivalent", "/")[0]))
    members = F.array_sort(F.collect_list(F.struct("idx", "id", "name", "first_modern")))
    met = seen.groupBy(F.lower("first_modern").alias("k")).agg(members.alias("m"))
    shown, names = F.col("m")[0]["first_modern"], F.transform("m", lambda x: x["name"])
    named = met.select(tx.slug(shown).alias("key"), F.col("m")[0]["id"].alias("entity"), shown.alias("shown"), an.reverse_sentence(shown, names).alias("answer"), names.alias("values"))
    return _lookups(named, templates, "ak", "reverse_name", "rev-", False)


def english_lookups(diagnoses: DataFrame, templates: DataFrame) -> DataFrame:
    """From an English name, whatever its case, to all seen diagnostic terms that have it."""
    members = F.array_sort(F.collect_list(F.struct("idx", "id", "name", "english")))
    met = diagnoses.where("`group` = 'seen'").groupBy(F.lower("english").alias("k")).agg(members.alias("m"))
    shown, names = F.col("m")[0]["english"], F.transform("m", lambda x: x["name"])
    answer = an.fill("The Ayurvedic (NAMASTE) term for {e} is {n}.", e=shown, n=tx.join_list(names))
    named = met.select(an.english_slug(shown).alias("key"), F.col("m")[0]["id"].alias("entity"), shown.alias("shown"), answer.alias("answer"), names.alias("values"))
    return _lookups(named, templates, "nm", "nm_reverse", "nmrev-", True)


def sampled(df: DataFrame, key: Column, most: int, salt: str) -> DataFrame:
    """At most so many rows, drawn by hash without replacement: a bounded top-k, merged from the partitions' own."""
    return df.orderBy(stable_int(salt, key), key).limit(most)


def follow_up_rows(facts: DataFrame, templates: DataFrame, follow_ups: DataFrame, most: int, salt: str) -> DataFrame:
    """Drafts of two-turn conversations of at most so many seen entities with two facts that have follow-ups.

    ``follow_ups`` are (attribute, place, follow). Some are also opened with entries, found by the
    follow-up and the first question together.
    """
    asked = small(follow_ups.groupBy("attribute").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "follow"))), lambda x: x["follow"]).alias("follows")))
    drawn = sampled(facts.where("`group` = 'seen'").select("entity").distinct(), F.col("entity"), most, salt)
    own = facts.join(drawn, "entity", "left_semi").join(asked, "attribute")
    turn = F.struct(stable_int("turn", F.col("entity"), F.col("attribute")).alias("h"), "attribute", "answer", "gold", "follows")
    pairs = own.groupBy("entity", "kind", "name").agg(F.array_sort(F.collect_list(turn), lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).when(a["attribute"] < b["attribute"], -1).otherwise(1)).alias("f")).where("size(f) >= 2")
    first, second = F.col("f")[0], F.col("f")[1]
    keyed = pairs.select("entity", "kind", "name", first.alias("a"), second.alias("b"), first["attribute"].alias("attribute"), slots_by_hash(fx.TRAIN_SLOTS, "turn-slot", F.col("entity"))[0].alias("slot"))
    joined = keyed.join(small(templates), ["kind", "attribute", "slot"])
    row_id = F.concat(F.col("entity"), F.lit("|"), F.col("a.attribute"), F.lit(">"), F.col("b.attribute"))
    history = F.array(F.struct(F.lit("user").alias("role"), F.replace("text", F.lit("{name}"), F.col("name")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("a.answer").alias("content")))
    follow = F.col("b.follows")[(stable_int("follow", row_id) % F.size("b.follows")).cast("int")]
    opens = F.explode(F.when(chance(fx.TWO_TURN_OPEN_SHARE, "multi-open", row_id), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    spread = joined.select("*", row_id.alias("key"), opens.alias("open_book"))
    return spread.select(
        F.lit("train").alias("split"), F.when(F.col("open_book"), F.concat(F.col("key"), F.lit("|open"))).otherwise(F.col("key")).alias("id"), follow.alias("question"), F.col("b.answer").alias("answer"), history.alias("history"),
        F.col("kind").alias("source"), "entity", "name", F.col("b.attribute").alias("attribute"), F.lit("seen").alias("group"), F.lit(None).cast("int").alias("slot"), "open_book", F.col("b.gold").alias("gold"), F.when(F.col("open_book"), F.col("entity")).alias("gold_id"), F.col("key").alias("salt"),
    )


def concept_rows(concepts: DataFrame, conversational: tuple[str, ...] = CONVERSATIONAL) -> DataFrame:
    """Drafts of concepts (id, questions, answer, key_terms): three closed ones and an open one to train, one each to validate and test."""
    made = [("train", 0, False), ("train", 1, False), ("train", 2, False), ("train", 0, True), ("validation", 3, False), ("test", 4, False)]
    spread = concepts.select("*", F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.lit(n).alias("slot"), F.lit(o).alias("open_book")) for s, n, o in made))).alias("r")).select("id", "questions", "answer", "key_terms", "r.*")
    entity = F.concat(F.lit("concept-"), F.col("id"))
    row_id = F.concat(entity, F.lit("|"), F.col("slot").cast("string"), F.when(F.col("open_book"), "|open").otherwise(""))
    return spread.select(
        "split", row_id.alias("id"), F.element_at("questions", F.col("slot") + 1).alias("question"), F.trim("answer").alias("answer"), _no_history().alias("history"), F.lit("concept").alias("source"), entity.alias("entity"),
        F.col("id").alias("name"), F.lit("concept").alias("attribute"), F.lit("concepts").alias("group"), "slot", "open_book", gold("terms", F.col("key_terms")).alias("gold"),
        F.when(F.col("open_book") & ~F.col("id").isin(*conversational), entity).alias("gold_id"), F.col("id").alias("salt"),
    )


def pair_rows(pairs: DataFrame) -> DataFrame:
    """Drafts of question and answer pairs (place, question, answer), to train only."""
    key = F.concat(F.lit("pdf-"), F.lpad(F.col("place").cast("string"), 2, "0"))
    return pairs.select(
        F.lit("train").alias("split"), key.alias("id"), F.trim("question").alias("question"), F.trim("answer").alias("answer"), _no_history().alias("history"), F.lit("pdf").alias("source"), key.alias("entity"), F.lit("pdf").alias("name"),
        F.lit("pdf_qa").alias("attribute"), F.lit("seen").alias("group"), F.lit(None).cast("int").alias("slot"), F.lit(False).alias("open_book"), gold("none").alias("gold"), F.lit(None).cast("string").alias("gold_id"), F.lit("").alias("salt"),
    )


def safety_rows(prompts_: DataFrame, fillers: dict[str, list[str]], answers: dict[str, str]) -> DataFrame:
    """Drafts of safety prompts (split, kind, place, prompt): a templated one to train is filled three times, others once.

    ``fillers`` are the lists for {herb}, {condition} and {drug}, picked by a hash and by its 7th and 11th parts.
    """
    fills = F.when(F.contains("prompt", F.lit("{")) & (F.col("split") == "train"), 3).otherwise(1)
    spread = prompts_.select("*", F.explode(F.sequence(F.lit(0), fills - 1)).alias("fill"))
    pick = stable_int(F.col("split"), F.col("kind"), F.col("place"), F.col("fill"))
    chosen = {k: F.element_at(F.array(*map(F.lit, fillers[k])), (F.floor(pick / by) % len(fillers[k]) + 1).cast("int")) for k, by in (("herb", 1), ("condition", 7), ("drug", 11))}

    def filled(text: Column) -> Column:
        for k, v in chosen.items():
            text = F.replace(text, F.lit("{" + k + "}"), v)
        return text

    answer = F.element_at(F.create_map(*(F.lit(x) for kv in answers.items() for x in kv)), F.col("kind"))
    key = F.concat_ws("-", F.lit("safety"), "split", "kind", F.col("place").cast("string"), F.col("fill").cast("string"))
    return spread.select(
        "split", key.alias("id"), filled(F.col("prompt")).alias("question"), filled(answer).alias("answer"), _no_history().alias("history"), F.lit("safety").alias("source"), F.lit("safety").alias("entity"), F.col("kind").alias("name"),
        F.concat(F.lit("safety_"), F.col("kind")).alias("attribute"), F.lit("safety").alias("group"), F.lit(None).cast("int").alias("slot"), F.lit(False).alias("open_book"), gold("safety", safety=F.col("kind")).alias("gold"), F.lit(None).cast("string").alias("gold_id"), F.lit("").alias("salt"),
    )


def diagnosis_rows(conditions: DataFrame, templates: dict[str, list[str]], answer: str, most: dict[str, int]) -> DataFrame:
    """Drafts of questions for a diagnosis, by the first three symptoms of seen conditions drawn by hash for each split."""
    out = None
    for split, asked in templates.items():
        drawn = sampled(conditions.where("`group` = 'seen'"), F.col("id"), most[split], f"diagnosis-{split}")
        symptoms = tx.join_list(an.lowered(F.slice(tx.split_list(F.col("symptoms")), 1, 3)))
        which = F.element_at(F.array(*map(F.lit, asked)), (stable_int("diagnosis", split, F.col("id")) % len(asked) + 1).cast("int"))
        # as the element of an array, the symptoms are made once
        made = drawn.select("id", "name", "modern_equivalent", which.alias("which"), F.explode(F.array(symptoms)).alias("symptoms"))
        rows = made.select(
            F.lit(split).alias("split"), F.concat(F.lit(f"safety-{split}-diagnosis-"), F.col("id")).alias("id"), F.replace("which", F.lit("{symptoms}"), F.col("symptoms")).alias("question"),
            an.fill(answer, symptoms=F.col("symptoms"), name=F.col("name"), modern=F.col("modern_equivalent")).alias("answer"), _no_history().alias("history"), F.lit("safety").alias("source"), F.col("id").alias("entity"), "name",
            F.lit("safety_diagnosis").alias("attribute"), F.lit("safety").alias("group"), F.lit(None).cast("int").alias("slot"), F.lit(False).alias("open_book"), gold("safety", safety="diagnosis").alias("gold"), F.lit(None).cast("string").alias("gold_id"), F.lit("").alias("salt"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def entries(drafts: DataFrame, cards: DataFrame, held_out: DataFrame) -> DataFrame:
    """(split, id, context_ids, contexts) of drafts that are opened: entries by retrieval with their question.

    Training sees no held-out entry (card_id). A two-turn question is searched with the one before. A miss is answered from
    memory: its entries are without the gold one.
    """
    before = F.try_element_at("history", F.lit(-2))["content"]
    asked = drafts.where("open_book").select(F.concat_ws("\x1f", "split", "id").alias("query_id"), F.concat_ws(" ", "question", before).alias("query"), "gold_id", "split")
    found = None
    missed = F.col("query_id").endswith("|miss")
    for training, own in ((True, (F.col("split") == "train") & ~missed), (True, missed), (False, F.col("split") != "train")):
        got = retrieval.contexts(cards, asked.where(own).drop("split"), held_out if training else None, include_gold=own is not missed)
        found = got if found is None else found.unionByName(got)
    texts = found.join(cards.select("card_id", "text"), "card_id")
    listed = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "card_id", "text"))).alias("x"))
    key = F.split("query_id", "\x1f")
    return listed.select(key[0].alias("split"), key[1].alias("id"), F.transform("x", lambda e: e["card_id"]).alias("context_ids"), F.transform("x", lambda e: e["text"]).alias("contexts"))


def rows(drafts: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """(split, id, question, messages, meta): the history, the question with its entries, and the answer.

    What only evaluation needs is null in the meta data of training rows.
    """
    if opened is None:
        joined = drafts.withColumns({"context_ids": F.array().cast("array<string>"), "contexts": F.array().cast("array<string>")})
    else:
        joined = drafts.join(opened, ["split", "id"], "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("context_ids", "contexts")})
    user = F.struct(F.lit("user").alias("role"), prompts.user_content(F.col("question"), F.col("contexts")).alias("content"))
    messages = F.concat("history", F.array(user, F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    evaluated = lambda c: F.when(F.col("split") != "train", c)
    meta = F.struct(
        "source", "entity", evaluated(F.col("name")).alias("name"), "attribute", "group", evaluated(F.col("slot")).alias("slot"), (F.size("context_ids") > 0).alias("open_book"), "context_ids",
        evaluated(F.size("history") > 0).alias("multi_turn"), evaluated(F.col("gold")).alias("gold"),
    )
    return joined.select("split", "id", "question", messages.alias("messages"), meta.alias("meta"))


def evaluation_rows(drafts: DataFrame, caps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All drafts but evaluation ones that exceed the caps, can't be scored by their own answer, or ask closed-book for
    a term that training mentions; and the counts (split, reason, n) of those."""
    held = drafts.where("split <> 'train'")
    kept = cut(splits.capped(held, caps), "capped")
    counts = [held.groupBy("split").agg(F.count("*").alias("a")).join(kept.groupBy("split").agg(F.count("*").alias("b")), "split", "left").select("split", F.lit("caps").alias("reason"), (F.col("a") - F.coalesce("b", F.lit(0))).alias("n"))]
    scored = kept.withColumn("__ok", (F.col("gold.type") == "none") | scoring.score_row(F.col("answer"), F.col("gold"), F.col("name"), F.col("source"), F.col("attribute"))["correct"])
    scored = cut(scored, "scored")
    counts.append(scored.groupBy("split").agg(F.sum(F.when(F.col("__ok"), 0).otherwise(1)).alias("n")).select("split", F.lit("unscorable").alias("reason"), "n"))
    fair = scored.where("__ok").drop("__ok")
    closed = fair.where("`group` IN ('unseen_closed', 'heldout_closed')")
    # training text: every message of the row, as they are written; all rows of a fact have one answer
    train = drafts.where("split = 'train'")
    said = train.select(F.explode(F.concat(F.transform("history", lambda m: m["content"]), F.array("question"))).alias("text")).unionByName(train.select(F.col("answer").alias("text")).distinct())
    hit = mentions.mentioned(closed.select(F.concat_ws("\x1f", "split", "id").alias("id"), "name"), said).distinct()
    hit = cut(hit, "mentioned")
    out = fair.withColumn("__key", F.concat_ws("\x1f", "split", "id")).join(hit.withColumnRenamed("id", "__key"), "__key", "left_anti").drop("__key")
    counts.append(hit.groupBy(F.split("id", "\x1f")[0].alias("split")).agg(F.count("*").alias("n")).select("split", F.lit("mentioned").alias("reason"), "n"))
    return drafts.where("split = 'train'").unionByName(out.select(*drafts.columns)), counts[0].unionByName(counts[1]).unionByName(counts[2])


def stats(final: DataFrame) -> DataFrame:
    """(split, grp, source, attribute, n, open_book): counts by split, and by split with group, source, or group and attribute."""
    flat = final.select("split", F.col("meta.group").alias("grp"), "meta.source", "meta.attribute", F.col("meta.open_book").cast("int").alias("open"))
    sets = [["split"], ["split", "grp"], ["split", "source"], ["split", "grp", "attribute"]]
    return flat.groupingSets([[F.col(c) for c in s] for s in sets], "split", "grp", "source", "attribute").agg(F.count("*").alias("n"), F.sum("open").alias("open_book"))


