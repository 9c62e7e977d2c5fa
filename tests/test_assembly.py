import hashlib
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import answers as an
from corpuswright.operators import assembly, corpus, entities, retrieval, splits
from corpuswright.plans import assembly_queries as q
from corpuswright.sources import build

SF = "/root/testdata/sf0.001"


def h(*parts):
    return int(hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def words(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return " " + " ".join(re.findall("[a-z0-9]+", bare)) + " "


def test_assembled_corpus_equals_a_plain_filter(spark):
    drafts = q.cut(q._drafts(spark, SF), "test")
    rows = [r.asDict(recursive=True) for r in drafts.collect()]
    assert len({(r["split"], r["id"]) for r in rows}) == len(rows)
    caps = {c[:3]: c[3] for c in splits.CAPS}
    said = [words(t) for r in rows if r["split"] == "train" for t in [*(m["content"] for m in r["history"]), r["question"], r["answer"]]]
    kept, drops, count = {(r["split"], r["id"]) for r in rows if r["split"] == "train"}, Counter(), Counter()
    for r in sorted((r for r in rows if r["split"] != "train"), key=lambda r: h("cap", r["split"], r["id"])):
        key = (r["split"], r["group"], r["source"])
        count[key] += 1
        if key in caps and count[key] > caps[key]:
            drops[r["split"], "caps"] += 1
        elif r["group"] in ("unseen_closed", "heldout_closed") and len(words(r["name"]).strip()) >= 4 and any(words(r["name"]) in t for t in said):
            drops[r["split"], "mentioned"] += 1
        else:
            kept.add((r["split"], r["id"]))
    got, notes = assembly.evaluation_rows(drafts, splits.caps_table(spark))
    told = {(n.split, n.reason): n.n for n in notes.collect() if n.n}
    unscorable = sum(n for (_, reason), n in told.items() if reason == "unscorable")
    have = {(r.split, r.id) for r in got.select("split", "id").collect()}
    assert have <= kept and len(kept) - len(have) == unscorable
    assert {k: n for k, n in told.items() if k[1] == "caps"} == {k: n for k, n in drops.items() if k[1] == "caps"}
    final = assembly.rows(got)
    flat = [(r.split, r.meta.group, r.meta.source, r.meta.attribute) for r in final.collect()]
    want = Counter(x for s, g, o, a in flat for x in ((s, None, None, None), (s, g, None, None), (s, None, o, None), (s, g, None, a)))
    assert {(r.split, r.grp, r.source, r.attribute): r.n for r in assembly.stats(final).collect()} == dict(want)
    assert final.where("split = 'train' AND (meta.gold IS NOT NULL OR meta.name IS NOT NULL)").count() == 0
    # held-out entities aren't trained on, questions of evaluation don't occur in training
    flat_rows = got.select("split", "id", "group", "question", "entity", "name")
    assert splits.question_overlap(flat_rows).isEmpty()


def test_two_turns_and_entries(spark):
    turns = [r for r in q.two_turn_rows(spark, SF).collect()]
    assert turns and len({r.entity for r in turns}) <= 500
    assert all('"role":"user"' in r.messages and r.messages.count('"role"') == 4 for r in turns)
    opened = q.open_book_rows(spark, SF).collect()
    assert opened and all(r.opened and r.entries <= 3 for r in opened)
    assert all(r.has_gold != r.id.endswith("|miss") for r in opened)


def test_entries_equal_plain_choice(spark):
    cards = spark.createDataFrame([(f"c{i}", f"stone {w}", f"{w} rock number {i}") for i, w in enumerate(("red", "red", "red", "red", "blue", "red", "red"))], "card_id string, title string, text string")
    draft = {"split": "train", "id": "a", "question": "red stone rock", "answer": "x", "source": "s", "entity": "c6", "name": "n", "attribute": "k", "group": "seen", "slot": 0, "open_book": True, "gold_id": "c6", "salt": ""}
    base = spark.createDataFrame([tuple(draft.values())], "split string, id string, question string, answer string, source string, entity string, name string, attribute string, `group` string, slot int, open_book boolean, gold_id string, salt string")
    drafts = base.withColumn("history", assembly._no_history()).withColumn("gold", entities.gold("none"))
    held = spark.createDataFrame([("c0",), ("c6",)], "card_id string")
    got = assembly.entries(drafts, cards, held).first()
    ranked = [r.card_id for r in retrieval.ranked(retrieval.scores(cards, base.select(F.lit(1).alias("query_id"), F.col("question").alias("query")))).orderBy("rank").collect()]
    want = [c for c in ranked if c not in ("c0", "c6")][:2] + ["c6"]
    assert set(got.context_ids) == set(want) and len(got.contexts) == 3
    row = assembly.rows(drafts, assembly.entries(drafts, cards, held)).first()
    assert row.messages[0].content.startswith("Knowledge base entries:\n[1] ") and row.meta.open_book


def test_unknown_values_raise(spark):
    one = spark.range(1)
    for column, match in ((an.dosha_sentence(F.lit("X"), F.lit("Vata/Foo")), "unknown factor: foo"), (an.system_sentence(F.lit("X"), F.lit("Skin/Tail")), "unknown body system: tail"), (an.prognosis_sentence(F.lit("X"), F.lit("Odd")), "unknown prognosis: odd")):
        with pytest.raises(Exception, match=match):
            one.select(column).collect()


def test_corpus_is_published_only_without_a_leak(spark, tmp_path):
    drafts, cards, known = q._disease_corpus(spark, SF)
    path, caps = f"file://{tmp_path}/corpus", splits.caps_table(spark)
    manifest = corpus.publish(spark, path, drafts, cards, known, caps, "p")
    rows = build.current(spark, path)[0]["rows"].collect()
    assert manifest["tables"]["rows"]["rows"] == len(rows) and {r.split for r in rows} == {"train", "validation", "test"}
    opened = [r for r in rows if r.meta.open_book]
    assert opened and all(r.messages[-2].content.startswith("Knowledge base entries:") and len(r.meta.context_ids) <= 3 for r in opened)
    held = {r.id for r in known.where("startswith(`group`, 'heldout')").collect()}
    assert held and not any(set(r.meta.context_ids) & held for r in opened if r.split == "train")
    # a test question that training has, of an entity that isn't known
    asked = drafts.where("split = 'train' AND NOT open_book").limit(1)
    planted = asked.withColumns({"split": F.lit("test"), "id": F.lit("planted"), "group": F.lit("heldout_open"), "entity": F.lit("nobody"), "source": F.lit("ag"), "gold": entities.gold("none")})
    with pytest.raises(build.BuildError) as e:
        corpus.publish(spark, path, drafts.unionByName(planted), cards, known, caps, "p")
    assert set(e.value.faults) == {"evaluation questions in training", "listed: no such entities"}
    assert build.current(spark, path)[1] == manifest
    build.verify(spark, path, corpus.KEY_OF)


def test_diseases_are_made_once_and_found_by_few_columns(spark):
    """Odd cells, ties and repeated numbers; and the entries' plan reads the diseases that were made, not their source."""
    columns = list(entities.DISEASE_COLUMNS)
    odd = ["Neem", " neem  leaf ", "N/A", "none specific", "", None, "-", "a\nb", "é  x", "nan\n", "\x85 na", "İ"]
    rows = [(i % 37, *(odd[(i * k + i // 5) % len(odd)] if k else f"Ache {i % 9}{odd[i % 12] or '!'}" for k in range(len(columns)))) for i in range(120)]
    source = spark.createDataFrame([r for i, r in enumerate(rows) if r[0] not in (x[0] for x in rows[:i])] + rows[37:40], "idx int, " + ", ".join(f"`{c}` string" for c in columns))
    plain = source.select("idx", *(entities.tx.clean(F.col(f"`{a}`")).alias(b) for a, b in entities.DISEASE_COLUMNS.items())).where("name <> ''")
    assert entities._cleaned(source, entities.DISEASE_COLUMNS, False).exceptAll(source.select("idx", *(entities.tx.clean(F.col(f"`{a}`")).alias(b) for a, b in entities.DISEASE_COLUMNS.items()))).isEmpty()
    want = splits.keep_best(plain, entities.tx.slug(F.col("name")), splits.informativeness("herbs", "yoga", "symptoms", "hindi_name"), "idx")
    got = entities.diseases(source, normalised=False)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    files = q.open_book_rows(spark, SF).inputFiles()
    assert files and not any("part.parquet" in f for f in files)


def test_entities_of_a_corpus_are_made_once(spark, monkeypatch):
    """What is drafted of entities reads the tables that were made, not their source; and one answer of a fact is scanned once."""
    read, lookups, scanned, mentioned = [], assembly.english_lookups, [], assembly.mentions.mentioned
    monkeypatch.setattr(assembly, "english_lookups", lambda d, t: read.append(d.inputFiles()) or lookups(d, t))
    drafts = q._drafts(spark, SF)
    assert read[0] and not any("part.parquet" in f or "customer.parquet" in f for f in read[0])
    monkeypatch.setattr(assembly.mentions, "mentioned", lambda n, t: scanned.append(t) or mentioned(n, t))
    assembly.evaluation_rows(drafts, splits.caps_table(spark))
    train = drafts.where("split = 'train'")
    told = {r.answer for r in train.select("answer").collect()}
    said = [r.text for r in scanned[0].collect()]
    assert set(said) == told | {r[0] for r in train.select("question").collect()} | {m for r in train.select(F.col("history.content")).collect() for m in r[0]}
    assert len(said) == len(told) + train.agg(F.sum(1 + F.size("history"))).first()[0] < 2 * train.count()


def test_conditions_are_found_by_their_names(spark):
    columns, odd = list(entities.CONDITION_COLUMNS), ["Vata", " a  b ", "N/A", "", None, "é  X", "É x", "nan\n"]
    rows = [(i, *(odd[(i * k + i // 5) % len(odd)] if k else f"{'aA'[i % 2]}{i % 11}{odd[i % 8] or ''}" if i % 7 else odd[i % 8] for k in range(len(columns)))) for i in range(150)]
    source = spark.createDataFrame(rows, "idx int, " + ", ".join(f"`{c}` string" for c in columns))
    plain = source.select("idx", *(entities.tx.clean(F.col(f"`{a}`")).alias(b) for a, b in entities.CONDITION_COLUMNS.items()))
    want = splits.keep_first(plain, F.lower("name"), "idx")
    got = entities.conditions(source, normalised=False)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and 5 < got.count() < 150
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_parents_of_hot_prefixes_and_terms_of_odd_cells(spark):
    """Many rows of one prefix meet its row by a broadcast of what the prefixes have, and cells are cleaned as the long way cleans them."""
    rows = [(f"i{i}", f"A-{i % 3}" if i < 6 else f"A-{i % 3}.{i}" if i % 4 else "A" if i % 8 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, code string, idx int")
    first = {c: i for i, c, _ in reversed(rows)}

    def parent(i, code):
        own = [first.get(code.rpartition(m)[0]) for m in ".-" if m in code] if code else []
        return next((p for p in own if p and p != i), None)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = splits.by_prefix(df, "id", "code", "idx")
        assert {r.id: r.parent for r in got.collect()} == {i: parent(i, c) for i, c, _ in rows}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tx, odd = entities.tx, ["a", "", None, " a", "a ", "a  b", "a\tb", " ", "a b", "x⇒y", "#san@guṇa# of", "#san@a", "a b", "vāta-x 1", "None", "null ", "\x85na", "a\x1cb", "\x0b", "-", "a#b"]
    cells = spark.createDataFrame([(x,) for x in odd], "x string")
    t = tx.squeeze(F.regexp_replace(F.translate(F.coalesce("x", F.lit("")), " ⇒", "  "), "#san@([^#]+)#", "$1"))
    want = F.when(F.lower(t).isin(*tx.TERM_NULL_WORDS), "").otherwise(t)
    assert cells.where(tx.clean_term(F.col("x")) != want).isEmpty()
    assert cells.where(~F.col("x").rlike(tx._UNEVEN_TERM)).count() == 5  # words and signs that are even already
