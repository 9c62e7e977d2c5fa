import random
import uuid

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import retrieval
from corpuswright.operators.kept_index import KeptIndex, Layout
from corpuswright.shared import root


def cards_of(n, seed=3):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(4))), " ".join(rng.choices(words, weights, k=rng.randrange(60)))) for i in range(n)]
    return rows + [(n, None, None), (n + 1, "", "the of"), (n + 2, "rare title", "rare words only here"), (n + 3, "rare title", "rare words only here")]


def hits(df):
    return sorted((r.query_id, r.card_id, r["rank"], round(r.score, 7)) for r in df.collect())


@pytest.fixture(scope="module")
def kept(spark):
    rows = cards_of(700)
    cards = spark.createDataFrame(rows, "card_id long, title string, text string")
    index = KeptIndex(spark, f"{root(spark)}/test-index-{uuid.uuid4().hex}", Layout(block_cards=8, buckets=4))
    assert index.segments() == []
    with pytest.raises(ValueError, match="no cards"):
        index.search(cards.selectExpr("card_id as query_id", "text as query"))
    for part in (cards.where("card_id < 300"), cards.where("card_id >= 300 AND card_id < 650"), cards.where("card_id >= 650")):
        index.add(part)
    return index, cards


def test_search_equals_the_index_made_anew(spark, kept):
    index, cards = kept
    assert KeptIndex(spark, index.path, index.layout).segments() == [0, 1, 2]  # it outlives the session's object
    rng = random.Random(8)
    asked = [(i, " ".join(f"word{min(299, int(rng.expovariate(0.05)))}" for _ in range(rng.randrange(1, 9)))) for i in range(40)] + [(90, "rare title"), (91, ""), (92, None), (93, "unheard"), (94, "of the")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    want = hits(retrieval.search(cards, queries, 5))
    assert hits(index.search(queries, 5)) == want and len(want) > 150
    assert hits(index.search(queries, 5, first_blocks=1)) == want
    banned = spark.createDataFrame([(q, c) for q, c, rank, _ in want if rank == 1], "query_id long, card_id long")
    assert hits(index.search(queries, 2, banned, min_score=2.0)) == hits(retrieval.search(cards, queries, 2, banned, 2.0))
    # ties of equal cards are told apart by their id
    assert [r[1] for r in want if r[0] == 90][:2] == [702, 703]


def test_few_blocks_are_scored(spark, kept):
    index, _ = kept
    queries = spark.createDataFrame([(1, "rare title word3"), (2, "word250 word1 word2")], "query_id long, query string")
    read = {r.query_id: (r.blocks, r["read"]) for r in index.reading(queries, 1, first_blocks=1).collect()}
    assert read[1][1] < read[1][0] / 4 and read[2][1] < read[2][0], read


def test_scan_names_the_terms(spark, kept):
    index, _ = kept
    plan = index._read("postings", ["rare", "titl"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(term" in plan
    assert index._read("postings", ["rare"]).select("term").distinct().count() == 1
    assert index._read("postings", None).where(F.col("text_most") > 0).count() > 100


def test_a_task_writes_its_own_blocks(spark, kept):
    index, cards = kept
    posts = index._read("postings", None).withColumn("file", F.input_file_name())
    # postings of a block and a folder lie in one file: they were not dealt out by their terms
    assert posts.groupBy("segment", "bucket", "block").agg(F.countDistinct("file").alias("n")).where("n > 1").count() == 0
    assert posts.where(F.col("text_most") > 0).count() > 100
    assert sum(r.cards for r in index._fields().collect()) == cards.count()  # cards without a word, too
