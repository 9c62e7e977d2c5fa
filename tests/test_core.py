import hashlib
import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuswright.functions import prompts, safety, scoring
from corpuswright.functions import text as tx
from corpuswright.functions.hashing import bucket
from corpuswright.operators import batching, evaluation, mentions, retrieval, serving, splits, tokens
from corpuswright.sources import files
from corpuswright.streaming import log


def values(spark, *columns, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return list(row.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_text_functions(spark):
    got = values(
        spark, tx.fold(F.col("a")), tx.clean(F.lit(" None  specific ")), tx.slug(F.lit("O'Neil & Sons, Ltd.")), tx.group_key(F.lit("Śūla (2)")),
        tx.join_list(tx.split_list(F.lit("oil (warm, of (sesame; mild)), rest.; walk) , ( open, end"))), tx.lower_first(F.lit("Dry mouth")), tx.lower_first(F.lit("pH drop")),
        F.array_join(tx.tokenize(F.lit("Please describe the joints with oedemah")), " "), tx.unmarked(F.lit("Ānāha ℂ")), tx.fold(F.lit("𝐁uch ｗｅｉß ñ κόσμος")), a="Āmaḥ GROß ﬂux",
    )
    assert got == ["amah gross flux", "", "o-neil-sons-ltd", "sula2", got[4], "dry mouth", "pH drop", got[7], "Anaha C", "buch weiss n κοσμοσ"]
    assert got[4] == "oil (warm, of (sesame; mild)), rest, walk), ( open and end"
    code, other, name, refs, feats = values(
        spark, tx.split_code(F.lit("QA-1 (SB12)")), tx.split_code(F.lit("SB12 (QA-1)")), tx.term_name(F.lit("(c) alpha / beta/ ; ,gamma")),
        tx.first_references(F.lit("Ah.Ni.3; Zz.1; Ah.U.2 ; Bp. 4"), {"Ah": "H", "Bp": "B"}), tx.features(F.lit("one sees dāha [burning], by touch tāpa [heat of skin]")),
    )
    assert (tuple(code), tuple(other), tuple(name)) == (("QA-1", "SB12"), ("QA-1", "SB12"), ("alpha", ["beta", "gamma"]))
    assert [tuple(r) for r in refs] == [("H", "Ah.Ni.3"), ("B", "Bp.4")]
    assert feats["items"] == ["burning", "heat of skin"] and feats.clause == "burning (one sees dāha) and heat of skin (by touch tāpa)"
    english, bare, short, cut, lowered = values(spark, tx.english_name(F.lit(" Gout (TM2) ,")), tx.without_parentheses(F.lit("Gout (acute) of toe (left)")), tx.short_definition(F.lit("pain. ")), tx.short_definition(F.lit("a b c d. e f g"), 5), tx.clean_term(F.lit("see #san@vāta# and\u00a0so\u21d2on")))
    assert (english, bare, short, cut, lowered) == ("Gout", "Gout of toe", "pain", "a b c d", "see vāta and so on")


def test_normalised_cells(spark):
    got = values(spark, tx.clean(F.lit("ｎ／ａ"), True), tx.clean_term(F.lit("e\u0301tat"), True), tx.fold_exact(F.lit("½ Ἀ")), safety.route(F.lit("ｓｕｉｃｉｄｅ")))
    assert got == ["", "\u00e9tat", "1\u20442 α", "self_harm"]


def test_hash_buckets(spark):
    import hashlib

    want = [int(hashlib.sha256(f"bucket\x1fkey {i}".encode()).hexdigest()[:12], 16) % 100 for i in range(9)]
    assert values(spark, *(bucket(F.lit(f"key {i}")) for i in range(9))) == want


CASES = [
    ("dosha_set", ["pitta"], "Burning here points to pitta alone.", None, None, 1.0, True),
    ("dosha_set", ["pitta", "rakta"], "Only rakta is disturbed.", None, None, 0.5, False),
    ("dosha_set", ["vata", "pitta", "kapha"], "A sannipata fever, the book says.", None, None, 1.0, True),
    ("dosha_set", ["balanced"], "No humour leads here.", None, None, 1.0, True),
    ("dosha_set", ["kapha"], "VĀTA-ŚŪLA shows kapha above all.", "Vāta-śūla", None, 1.0, True),
    ("dosha_set", ["agantuja"], "An exogenous injury brought it on, in the medovaha channels.", None, None, 1.0, True),
    ("category", ["moderate"], "The outlook is guarded at best.", None, None, 1.0, True),
    ("category", ["variable"], "That varies, though often it is difficult.", None, None, 1.0, True),
    ("category", ["difficult"], "Early on it is curable, later difficult.", None, None, 0.0, False),
    ("category", ["madhava nidana"], "Only Madhava has it.", None, None, 1.0, True),
    ("source_any", ["bhavaprakasha", "charaka samhita"], "The Bhava Prakash lists it, then Sushruta.", None, None, 1.0, True),
    ("phrase", ["Oedema of the ankles"], "ankles, edema at dusk", None, None, 1.0, True),
    ("phrase", ["alpha beta gamma delta"], "gamma, beta, alpha", None, None, 1.0, True),
    ("phrase", ["alpha beta gamma"], "gamma, beta", None, None, 0.0, False),
    ("items", ["Sour belching", "Loose stools", "Thirst"], "He is thirsty, with sour belches.", None, None, 2 / 3, True),
    ("items", [], "anything", None, None, 0.0, False),
    ("system", ["urinary", "skin"], "The bladder suffers.", None, None, 0.5, True),
    ("exact", ["ताप है"], "इसे  ताप\n है कहते", None, None, 1.0, True),
    ("terms", ["heat|cold", "rest"], "wrestling in the heat", None, None, 0.5, True),
    ("safety", [], "Swallow 3 capsules, and ask a vaidya.", None, "dose", 0.0, False),
    ("safety", [], "Let a physician see the papers.", None, "medication", 1.0, True),
    ("safety", [], "Drive to a hospital.", None, "emergency", 1.0, True),
    ("safety", [], "Please talk to someone.", None, "self_harm", 1.0, True),
]


def test_scores(spark):
    rows = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(CASES)], "i int, kind string, vals array<string>, answer string, name string, safety string")
    simple = scoring.score_gold(*(F.col(c) for c in ("kind", "vals", "answer", "name", "safety")))
    parts = F.array(F.struct(F.lit("phrase").alias("type"), F.array(F.lit("bladder")).alias("values")), F.struct(F.lit("dosha_set").alias("type"), F.array(F.lit("pitta")).alias("values")))
    both = scoring.score_gold(F.lit("composite"), F.array().cast("array<string>"), F.col("answer"), F.col("name"), F.col("safety"), parts)
    got = rows.select("i", simple.alias("s"), both.alias("b")).orderBy("i").collect()
    for (_, _, answer, *_, score, correct), r in zip(CASES, got):
        assert (round(r.s.score, 9), r.s.correct) == (round(score, 9), correct), answer
    assert [(r.b.score, r.b.correct) for r in (got[0], got[16], got[6])] == [(0.5, True), (0.5, True), (0.0, False)]
    with pytest.raises(Exception, match="unknown gold type: odd"):
        values(spark, scoring.score_gold(F.lit("odd"), F.array(F.lit("x")), F.lit("a"), F.lit("n"), F.lit("k")))
    f1, none, rouge, flat = values(spark, scoring.token_f1(F.lit("salt, salt, water"), F.lit("water with salt")), scoring.token_f1(F.lit("salt"), F.lit("")), scoring.rouge_l(F.lit("red green blue gold"), F.lit("green red gold")), scoring.rouge_l(F.lit(""), F.lit("x")))
    assert (round(f1, 9), none, round(rouge, 9), flat) == (0.8, 0.0, round(4 / 7, 9), 0.0)


def test_rows_are_scored_without_echoed_names(spark):
    gold = F.struct(F.lit("phrase").alias("type"), F.array(F.lit("shula")).alias("values"), F.lit(None).cast("array<struct<type:string,values:array<string>>>").alias("parts"), F.lit(None).cast("string").alias("kind"))
    score = lambda source, attribute: scoring.row_metrics(F.lit("It is vata shula, nothing else."), F.lit("vata shula"), gold, F.lit("Vāta Śhula"), F.lit(source), F.lit(attribute))
    term, condition, lookup = values(spark, score("nm", "nm_english"), score("ak", "dosha"), score("nm", "nm_reverse"))
    assert (term.score, term.correct, condition.score, lookup.correct) == (0.0, False, 1.0, True)
    assert (term.answer_words, term.token_f1, term.rouge_l) == (6, round(2 * 2 / 6, 4), round(2 * 2 / 6, 4))


def test_rounding_is_that_of_exact_binary_values(spark):
    import random

    r = random.Random(3)
    xs = [r.random() * 10 ** r.randrange(-4, 6) for _ in range(300)] + [k / 8 for k in range(-40, 40)] + [k / 1000 + 0.0005 for k in range(200)] + [2.675, 1.005, 0.5, 1.5, -2.5]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", *(scoring.half_even(F.col("x"), d).alias(f"d{d}") for d in (0, 2, 3, 4))).orderBy("i").collect()
    for x, row in zip(xs, got):
        assert [row.d0, row.d2, row.d3, row.d4] == [float(round(x, d)) for d in (0, 2, 3, 4)], x
    assert values(spark, scoring.percent(F.lit(0.1234)), scoring.percent(F.lit(None).cast("double"))) == ["12.3%", "\u2013"]


def test_prompts(spark):
    opened, cleaned, done = values(spark, prompts.user_content(F.lit(" Why salt? "), F.array(F.lit("salt is white"), F.lit("sea"))), prompts.clean_generation(F.lit("<think>no\nyes</think> Because.<|endoftext|>x")), prompts.completion_text(F.lit("\tBecause.\n")))
    assert opened == "Knowledge base entries:\n[1] salt is white\n[2] sea\n\nQuestion: Why salt?"
    assert (cleaned, done) == ("Because.", "Because.<|im_end|>")
    messages = prompts.build_messages(F.lit("Be brief"), F.array(prompts.message("user", F.lit("Hm?")), prompts.message("assistant", F.lit("Aha"))), F.lit("So "), F.array().cast("array<string>"))
    (text,) = values(spark, prompts.render_prompt(messages))
    turns = [("system", "Be brief"), ("user", "Hm?"), ("assistant", "Aha"), ("user", "So")]
    assert text == "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in turns) + "<|im_start|>assistant\n<think>\n\n</think>\n\n"
    with pytest.raises(Exception, match="user message"):
        values(spark, prompts.render_prompt(F.array(prompts.message("system", F.lit("alone")))))
    late = F.array(prompts.message("user", F.lit("a")), prompts.message("system", F.lit("b")), prompts.message("user", F.lit("c")))
    turn = lambda role, text: prompts.message(role, F.lit(text))
    faults = values(spark, prompts.message_fault(late), prompts.history_fault(F.lit("\n"), F.array(turn("user", "y"))), prompts.history_fault(F.lit("ok"), F.array(turn("assistant", "y"))), prompts.history_fault(F.lit("ok"), F.array(turn("assistant", "a"), turn("user", "b"))), prompts.history_fault(F.lit("ok"), F.array(turn("user", "a"), turn("assistant", " "))), prompts.history_fault(F.lit("z" * 4001), F.array(turn("user", "a"), turn("assistant", "b"))))
    assert faults == ["the system message must come first", "blank message", "history is not made of pairs", "history does not alternate", "bad history text", "message too long"]


def test_safety(spark):
    asks = ["My lips are turning blue since noon", "What dosage would be the right dose?", "Where does sandalwood grow?", "lately I am planning to harm   myself", "Can’t breathe", None]
    assert values(spark, *(safety.route(F.lit(a).cast("string")) for a in asks)) == ["urgent", "dose", "answer", "self_harm", "urgent", "answer"]
    bad, good = values(spark, safety.guard(F.lit("Some 2-3 tsp per day suffice."), F.lit("no")), safety.guard(F.lit("Spoons exist."), F.lit("no")))
    assert (tuple(bad), tuple(good)) == (("no", True), ("Spoons exist.", False))


CARDS = [(0, "Granite", "A hard rock with quartz."), (1, "Basalt", "Dark rock from lava flows."), (2, "Empty", None), (3, "Lava", "Molten rock; it cools to basalt or obsidian.")]


def test_bm25(spark):
    cards = spark.createDataFrame(CARDS, "card_id long, title string, text string")
    queries = spark.createDataFrame([(1, "Is granite quartz?"), (2, "thank you, doctor"), (3, "lava")], "query_id long, query string")
    assert [(r.query_id, r.card_id) for r in retrieval.search(cards, queries, 1).orderBy("query_id").collect()] == [(1, 0), (3, 3)]


def test_chat_batch(spark):
    cards = spark.createDataFrame([(i, t, "stones", x) for i, t, x in CARDS] * 1, "card_id long, title string, source string, text string")
    turn = "array<struct<role:string,content:string>>"
    asked = [("a", "What is granite made of, quartz?", []), ("b", "I want to end my life", []), ("c", "And where?", [("user", "Tell of basalt lava flows"), ("assistant", "Dark.")]), ("d", "Hello", []), ("e", "How many tablets should I take", []), ("f", "Granite quartz again", [])]
    requests = spark.createDataFrame(asked, f"id string, message string, history {turn}")
    reply = lambda p: p.withColumn("answer", F.when(F.contains("prompt", F.lit("again")), "Take 2 ml daily").otherwise(F.concat(F.lit("seen: "), F.regexp_count("prompt", F.lit(r"\[\d\] ")).cast("string"))))
    out = {r.id: r for r in serving.chat(requests, cards, "S", {"urgent": "call", "self_harm": "talk", "dose": "ask"}, reply).collect()}
    hits = retrieval.search(cards, serving.search_queries(requests), 3).collect()
    best = {}
    for h in hits:
        best.setdefault(h.query_id, []).append((h.score, h.card_id))
    for i in "acdf":
        found = best.get(i, []) if max([s for s, _ in best.get(i, [])], default=0) >= retrieval.GATE_SCORE else []
        assert out[i]["mode"] == ("finetuned_rag" if found else "finetuned")
        assert {c.card_id for c in out[i].citations} == {str(c) for s, c in found if s >= 0.6 * max(found)[0]}
        if i != "f":
            assert out[i].answer == f"seen: {len(found)}" and out[i].outcome == "answered"
    assert (out["f"].answer, out["f"].outcome, out["f"].warning) == ("ask", "refused", "dose_removed")
    assert [(out[i].answer, out[i]["mode"], out[i].outcome) for i in "be"] == [("talk", "safety", "urgent"), ("ask", "safety", "refused")]
    with pytest.raises(Exception, match="empty answer"):
        serving.chat(requests, cards, "S", {"urgent": "call", "self_harm": "talk", "dose": "ask"}, lambda p: p.withColumn("answer", F.lit(" "))).collect()


def test_caps_and_places(spark):
    import hashlib

    h = lambda *p: int(hashlib.sha256("\x1f".join(map(str, p)).encode()).hexdigest()[:12], 16)
    rows = [("test", f"r{i}", "g" if i % 3 else "free", "s") for i in range(90)]
    df = spark.createDataFrame(rows, "split string, id string, `group` string, source string")
    caps = spark.createDataFrame([("test", "g", "s", 7), ("test", "other", "s", 1000)], "split string, `group` string, source string, most long")
    want = {r[1] for r in rows if r[2] == "free"} | {r[1] for r in sorted((r for r in rows if r[2] == "g"), key=lambda r: h("cap", "test", r[1]))[:7]}
    assert {r.id for r in splits.capped(df, caps).collect()} == want
    needles = spark.createDataFrame([("a", "Red Ōre"), ("b", "ore"), ("c", "dark ore vein"), ("d", "none such")], "id string, name string")
    texts = spark.createDataFrame([("The RED ore, found",), ("a dark ore",), (None,)], "text string")
    assert {r.id for r in mentions.mentioned(needles, texts).collect()} == {"a"}
    assert {r.id for r in mentions.mentioned(needles, texts, 3).collect()} == {"a", "b"}


def test_twins_and_best(spark):
    rows = spark.createDataFrame([("a", 1, "", "x"), ("a", 2, "full", "y"), ("b", 3, "", "z")], "id string, idx int, definition string, name string")
    assert sorted(tuple(r) for r in splits.merge_twins(rows, "id", "idx", ["definition"]).select("id", "definition", "name").collect()) == [("a", "full", "x"), ("b", "", "z")]
    best = splits.keep_best(rows, F.col("id"), splits.informativeness("definition", "name"), "idx")
    assert sorted((r.id, r.idx) for r in best.collect()) == [("a", 2), ("b", 3)]


def test_batches_fit_and_are_deterministic(spark):
    lengths = [(i * i * 7 + 13 * i) % 611 + 9 for i in range(1700)]
    examples = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    got = batching.pack(examples, 2048)
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(1700))
    cost = batching.costs(got).toPandas()
    assert cost["cost"].max() <= 2048 and cost["cost"].sum() / sum(lengths) < 1.1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, batching.pack(examples.repartition(5), 2048).collect()))
    placed = batching.epoch_order(batching.costs(got), 1, 0).collect()
    assert sorted(r.place for r in placed) == list(range(len(cost)))
    assert next(r for r in placed if r.place == 0)["cost"] == cost["cost"].max()
    other = {(r.pool, r.batch): r.place for r in batching.epoch_order(batching.costs(got), 1, 1).collect()}
    assert other != {(r.pool, r.batch): r.place for r in placed}
    with pytest.raises(Exception, match="exceeds the budget"):
        batching.pack(examples, 300).count()
    (filled,) = values(spark, batching.collate(F.array(*map(F.lit, (5, 6))), F.array(*map(F.lit, (-100, 6))), F.lit(4), 0))
    assert tuple(filled) == ([5, 6, 0, 0], [-100, 6, -100, -100], [1, 1, 0, 0])


def test_intervals(spark):
    from math import comb

    ci, none, p, one = values(spark, evaluation.wilson(F.lit(40), F.lit(50)), evaluation.wilson(F.lit(0), F.lit(0)), evaluation.mcnemar(F.lit(3), F.lit(11)), evaluation.mcnemar(F.lit(0), F.lit(0)))
    assert (round(ci.low, 4), round(ci.high, 4), tuple(none)) == (0.6696, 0.8876, (0.0, 0.0))
    assert round(p, 9) == round(2 * sum(comb(14, i) for i in range(4)) / 2**14, 9) and one == 1.0


def test_log_summaries(spark):
    log_ = spark.createDataFrame([(1, 10, None), (2, 40, 0.5), (3, 30, 0.25), (4, 20, 0.75)], "step int, tokens_per_second long, eval_loss double")
    assert tuple(evaluation.run_summary(log_).first()) == (30, 0.25, 3)
    results = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "id string, model string")
    assert {r.id for r in evaluation.answered_by_all(results, "id", ("x", "y")).collect()} == {"a"}
    stored = spark.createDataFrame([("a", "x", 1, "old", 0), ("a", "x", 2, "new", 0)], "id string, model string, at int, answer string, metrics int")
    again = evaluation.rescored(spark.createDataFrame([("a", "ref")], "id string, reference string"), stored, ["id"], F.length("answer") + F.length("reference"), "at").first()
    assert (again.answer, again.metrics) == ("new", 6)
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["u", "v", "", None], ["v", "w"]))
    assert [r.k for r in splits.set_difference(a, b, "k").collect()] == ["u"]
    assert [splits.is_covered(x, y, "k").first().covered for x, y in ((a, b), (b, b))] == [False, True]


def test_examples_are_masked(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = [[("user", "Wo?"), ("assistant", " Über den Fluß. ")], [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d" * 300)]]
    rows = spark.createDataFrame([(f"r{i}", "train", m) for i, m in enumerate(turns)], "id string, split string, messages array<struct<role:string,content:string>>")
    made = tokens.examples(rows, "S", path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for r in made.collect():
        own = [x for x in r.labels if x != -100]
        assert r.input_ids[-len(own) :] == own == t.encode(r.answer + "<|im_end|>", add_special_tokens=False).ids
        assert r.labels[: -len(own)] == [-100] * (len(r.labels) - len(own))
    assert tokens.mask_faults(made, path).count() == 0
    broken = made.withColumn("labels", F.slice("labels", 1, F.size("labels") - 1))
    assert tokens.mask_faults(broken, path).count() == 2
    most = min(len(r.input_ids) for r in made.collect())
    assert tokens.examples(rows, "S", path, most).count() == 1
    assert tokens.report(made).first()["rows"] == 2
    with pytest.raises(Exception, match="must end with a user"):
        tokens.examples(rows.withColumn("messages", F.slice("messages", 1, 1)), "S", path).collect()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'\xef\xbb\xbfname,code\n"a, ""b""\nc",1\nd,\n')
    table = files.read_csv(spark, f"file://{tmp_path}/t.csv", ["name", "code"], 2)
    assert [tuple(r) for r in table.collect()] == [('a, "b"\nc', "1"), ("d", "")]
    with pytest.raises(ValueError, match="expected 3 rows"):
        files.read_csv(spark, f"file://{tmp_path}/t.csv", ["name", "code"], 3)
    rows = spark.range(20).selectExpr("cast(id as string) as id", "id as n")
    files.write_ordered(rows, f"file://{tmp_path}/out", "train", "id")
    assert files.read_jsonl(spark, f"file://{tmp_path}/out", "id string, n long").count() == 20
    found = files.content_hashes(spark, f"file://{tmp_path}/out/*.gz")
    assert files.manifest_faults(found, found).isEmpty()
    more = found.unionByName(spark.createDataFrame([("gone", "0")], "file string, sha256 string"))
    assert [tuple(r) for r in files.manifest_faults(more, found).collect()] == [("gone", "missing")]
    # equal content in files with other gzip headers
    import gzip
    import io

    for name, at in (("a.gz", 1), ("b.gz", 2)):
        raw = io.BytesIO()
        with gzip.GzipFile(filename=name, mode="wb", fileobj=raw, mtime=at) as f:
            f.write(b"same")
        (tmp_path / name).write_bytes(raw.getvalue())
    hashes = {r.file: r.sha256 for r in files.content_hashes(spark, f"file://{tmp_path}/*.gz").collect()}
    assert hashes["a.gz"] == hashes["b.gz"] == hashlib.sha256(b"same").hexdigest()
    for _ in range(2):  # replaced as a whole
        files.write_relational({"rows": rows, "plain": rows}, {"rows": ["id"]}, f"file://{tmp_path}/db")
    assert spark.read.parquet(f"file://{tmp_path}/db/plain").count() == 20
    with pytest.raises(ValueError, match="repeated keys"):
        files.write_relational({"rows": rows.unionAll(rows)}, {"rows": ["id"]}, f"file://{tmp_path}/db")
    with pytest.raises(ValueError, match="audit failed: leak"):
        files.write_relational({"rows": rows}, {}, f"file://{tmp_path}/db", {"leak": rows})
    assert sorted(x.name for x in tmp_path.iterdir() if x.name.startswith("db")) == ["db"]
    assert files.resolve(spark, f"file://{tmp_path}", "a.gz", hashlib.sha256((tmp_path / "a.gz").read_bytes()).hexdigest()).endswith("a.gz")
    for name, error in (("a.gz", ValueError), ("none.csv", FileNotFoundError)):
        with pytest.raises(error):
            files.resolve(spark, f"file://{tmp_path}", name, "0")


def test_manifest_and_small_files(spark, tmp_path):
    outputs = spark.createDataFrame([("x", "1"), ("y", "2")], "file string, sha256 string")
    held = files.manifest({"in": "0"}, outputs, "prompt")
    files.write_json(spark, held, f"file://{tmp_path}/MANIFEST.json")
    files.write_json(spark, held, f"file://{tmp_path}/MANIFEST.json")
    assert json.loads((tmp_path / "MANIFEST.json").read_text()) == held
    files.verify_manifest(held, outputs, "prompt")
    with pytest.raises(ValueError, match="y: mismatch; z: missing; the system prompt differs"):
        files.verify_manifest({**held, "outputs": {"x": "1", "y": "3", "z": "4"}}, outputs, "another")
    cards = spark.createDataFrame([("a", "T", "s", "t")], "card_id string, title string, source string, text string")
    files.write_cards(cards, f"file://{tmp_path}/cards")
    assert files.read_cards(spark, f"file://{tmp_path}/cards").collect() == cards.collect()
    files.write_cards(cards.unionAll(cards), f"file://{tmp_path}/twice")
    with pytest.raises(ValueError, match="repeated ids"):
        files.read_cards(spark, f"file://{tmp_path}/twice")
    assert files.provenance(spark, [{"id": "a", "name": "n"}]).first().url == ""
    config = {"output_dir": "/a", "base_model": {"local_dir": "/b", "id": 1}}
    assert files.run_fingerprint(config, {}) == files.run_fingerprint({"base_model": {"id": 1}}, {}) != files.run_fingerprint(config, {"x": "y"})


def test_curated_files(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "t.yaml").write_text(yaml.safe_dump({"k": {"a": [f"{{name}} {i}" for i in range(7)]}}))
    assert files.read_templates(spark, f"{tmp_path}/t.yaml").count() == 7
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"concepts": [{"id": "x", "questions": list("abcde"), "answer": "y", "key_terms": ["z"]}]}))
    assert files.read_concepts(spark, f"{tmp_path}/c.yaml").first().questions == list("abcde")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump({"train": {"dose": ["p", "q"]}, "test": {"dose": ["r"]}, "answers": {"dose": "no"}}))
    prompts_, rest = files.read_safety(spark, f"{tmp_path}/s.yaml")
    assert (prompts_.count(), rest) == (3, {"answers": {"dose": "no"}})
    (tmp_path / "p.yaml").write_text(yaml.safe_dump({"pairs": [{"question": " q ", "answer": "a"}]}))
    assert files.read_pairs(spark, f"{tmp_path}/p.yaml", 1).first().question == "q"
    assert files.read_config(f"{tmp_path}/s.yaml", {"answers.dose": "yes"})["answers"]["dose"] == "yes"


def test_streamed_log_keeps_the_latest(spark, tmp_path):
    schema = "id string, model string, step long, answer string"
    folder = f"file://{tmp_path}/log"
    for n in range(2):
        spark.createDataFrame([("a", "m", n, f"v{n}"), (f"b{n}", "m", n, "x")], schema).coalesce(1).write.mode("append").json(folder)
        log.keep_latest(log.read_log(spark, folder, schema), ["id", "model"], "step", f"file://{tmp_path}/table", f"file://{tmp_path}/check").awaitTermination(60)
    got = log.latest(spark, f"file://{tmp_path}/table", ["id", "model"], "step")
    assert sorted((r.id, r.answer) for r in got.collect()) == [("a", "v1"), ("b0", "x"), ("b1", "x")]


def test_safety_policy_is_a_file(spark, tmp_path):
    config = {"query_patterns": {"self_harm": [r"\bsad\b"], "urgent": ["fire|flood", "smoke"], "dose": ["how many (?:cups|spoons)"]}, "dose_in_answer": r"\d+ cups", "responses": {"self_harm": "talk", "urgent": "call", "dose": "ask"}}
    for name, text in (("p.json", json.dumps(config)), ("p.yaml", json.dumps(config))):  # JSON is YAML too
        path = tmp_path / name
        path.write_text(text)
        if name.endswith("yaml"):
            pytest.importorskip("yaml")
        policy = safety.Policy.read(path, need_responses=True)
        asks = ["I am SAD, fire!", "much  smoke", "How many spoons?", "how much of it?", None]
        routes = [safety.route(F.lit(a).cast("string"), policy) for a in asks]
        assert values(spark, *routes) == ["self_harm", "urgent", "dose", "answer", "answer"]
        assert values(spark, *(safety.response(r, policy) for r in routes)) == ["talk", "call", "ask", None, None]
        assert values(spark, safety.states_dose(F.lit("Take 3 CUPS"), policy), safety.states_dose(F.lit("Take 3 mg"), policy)) == [True, False]
    with pytest.raises(ValueError, match="missing urgent"):
        safety.Policy.of({**config, "query_patterns": {"self_harm": ["x"], "dose": ["y"]}})
    with pytest.raises(ValueError, match="missing dose"):
        safety.Policy.of({**config, "responses": {"self_harm": "a", "urgent": "b"}}, need_responses=True)
    assert safety.Policy.of(config).routes[1] == ("urgent", ("fire|flood", "smoke"))
