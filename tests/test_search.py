import random

import pytest

from corpuswright.operators import retrieval
from corpuswright.plans import answer_queries

from .test_kept_index import cards_of, hits


@pytest.mark.parametrize("most", [1 << 12, 7])
def test_search_equals_scores_of_all_pairs(spark, monkeypatch, most):
    """In one pass and in several, with bans and equal cards; only each task's best cards are shuffled, not every pair."""
    monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
    cards = spark.createDataFrame(cards_of(400), "card_id long, title string, text string").repartition(3)
    rng = random.Random(8)
    asked = [(i, " ".join(f"word{min(299, int(rng.expovariate(0.05)))}" for _ in range(rng.randrange(1, 9)))) for i in range(20)] + [(90, "rare title"), (91, ""), (92, None), (93, "unheard")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    every = retrieval.scores(cards, queries)
    want = hits(retrieval.ranked(every, 3))
    assert hits(retrieval.search(cards, queries, 3)) == want and len(want) > 50
    assert retrieval.best(cards, queries, 3).count() <= 3 * 3 * len(asked) < every.count()
    pairs = spark.createDataFrame([(q, c) for q, c, rank, _ in want if rank == 1], "query_id long, card_id long")
    assert hits(retrieval.search(cards, queries, 2, pairs, 2.0)) == hits(retrieval.ranked(every.where("score >= 2").join(pairs, ["query_id", "card_id"], "left_anti"), 2))
    only = spark.createDataFrame([(c, [0, 90]) for _, c, rank, _ in want if rank == 1], "card_id long, only array<long>")
    allowed = every.join(only, "card_id", "left").where("only IS NULL OR array_contains(only, query_id)").drop("only")
    assert hits(retrieval.ranked(retrieval.best(cards, queries, 3, only=only), 3)) == hits(retrieval.ranked(allowed, 3))


def test_terms_of_cards_are_counted_without_postings(spark):
    cards = spark.createDataFrame(cards_of(50), "card_id long, title string, text string")
    want = sorted(map(tuple, retrieval.idf(*retrieval.index(cards)).select("field", "term", "df", "idf").collect()))
    got = retrieval.frequencies(cards)
    assert sorted(map(tuple, got.collect())) == want
    assert "card_id" not in got._jdf.queryExecution().executedPlan().toString()


def test_items_are_tagged_once_an_item(spark, sf_dir):
    """What is made of an item stands below the join, where a row is an item."""
    plan = answer_queries.jaccard_tags(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, line in enumerate(plan.split("\n")) if "Join" in line)
    assert any("item_tags" in line for line in plan.split("\n")[join + 1 :])


def test_terms_are_counted_once_for_all_passes(spark, monkeypatch):
    """Cards are read for their terms as often in one pass as in many, and a query without a known term finds nothing."""
    made = []
    stats = retrieval._term_stats
    monkeypatch.setattr(retrieval, "_term_stats", lambda *a: made.append(1) or stats(*a))
    cards = spark.createDataFrame(cards_of(60), "card_id long, title string, text string")
    queries = spark.createDataFrame([(i, f"word{i} word{2 * i} unheard") for i in range(40)] + [(90, "unheard")], "query_id long, query string")
    want = hits(retrieval.ranked(retrieval.scores(cards, queries), 3))
    for most in (1 << 12, 3):
        monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
        spark.sparkContext.setJobGroup(f"most-{most}", "")
        found = retrieval.best(cards, queries, 3)
        made.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"most-{most}")))
        assert hits(retrieval.ranked(found, 3)) == want and want
    assert made[0] == made[2] == 1 and len(made) == 4


@pytest.mark.parametrize("listed,known", [(1 << 19, 1 << 20), (9, 5)])
def test_gold_hits_equal_search(spark, monkeypatch, listed, known):
    """Copies, ties, golds that are absent, null, poor or without a term; classes in one pass and in several, cards narrowed by terms or not."""
    monkeypatch.setattr(retrieval, "MOST_LISTED", listed)
    monkeypatch.setattr(retrieval, "MOST_KNOWN", known)
    rows = cards_of(300)
    rows += [(1000 + i, t, x) for i, (_, t, x) in enumerate(rows[:40])] + [(2000 + i, "same title", f"same title word{i % 3}") for i in range(30)]
    cards = spark.createDataFrame(rows, "card_id long, title string, text string").repartition(3)
    asked = [(i, t, c) for i, (c, t, _) in enumerate(rows) if i % 3 == 0]
    rng = random.Random(5)
    asked += [(5000 + i, " ".join(f"word{min(299, int(rng.expovariate(0.05)))}" for _ in range(rng.randrange(1, 9))), rng.choice(rows)[0]) for i in range(60)]
    asked += [(9000, "same title", 10**6), (9001, "same title", None), (9002, "", 3), (9003, None, 3), (9004, "unheard", 3), (9005, "same same title", 2000), (9006, "title the SAME", 2000)]
    queries = spark.createDataFrame(asked, "query_id long, query string, gold_id long")
    gold = {q: g for q, _, g in asked}
    for k in (1, 3):
        want = [r for r in hits(retrieval.search(cards, queries.drop("gold_id"), k)) if gold[r[0]] == r[1]]
        assert hits(retrieval.gold_hits(cards, queries, k)) == want and 40 < len(want) < len(asked)
    assert retrieval.gold_hits(cards, queries.where("gold_id IS NULL")).isEmpty()


def test_recall_scores_few_pairs(spark, monkeypatch, sf_dir):
    """Only cards that can come before a gold card are scored: no search of all cards for all queries, and few pairs of a class and a card."""
    from corpuswright.plans import retrieval_queries

    monkeypatch.setattr(retrieval, "best", None)
    scored, reaching = spark.sparkContext.accumulator(0), retrieval._reaching

    def counting(sent, k, card_type):
        asked, finds, _ = sent.value
        for of_field in finds:
            scored.add(int(of_field.sum()))
        scored.add(-len(asked.term))  # each term would find cards by both of its fields
        return reaching(sent, k, card_type)

    monkeypatch.setattr(retrieval, "_reaching", counting)
    row = retrieval_queries.retrieval_recall_at_3(spark, sf_dir).first()
    assert row.queries > 0 and row.hits > 0 and scored.value < 0


def test_stems_of_distinct_words_equal_tokens(spark):
    from itertools import product

    import pyarrow as pa

    from corpuswright.functions import text as tx

    words = ["".join(x) for n in range(1, 6) for x in product("ash1b", repeat=n)] + ["thes", "glass", "rasah", *tx.STOPWORDS]
    stems, token = tx.word_stems(pa.array(["", *words]))
    want = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.tokenize("w").alias("t")).collect()
    assert not token[0] and {r.w: r.t for r in want} == {w: [s] if keep else [] for w, s, keep in zip(words, stems.to_pylist()[1:], token[1:])}
