import random
import re

import pytest

from corpuswright.operators import mentions


def joined(text):
    return " ".join(re.findall("[a-z0-9]+", (text or "").lower()))


def plain(needles, texts, shortest=4, across=False):
    said = [joined(t) for t in texts]
    said = [" ".join(x for x in said if x)] if across else said
    return sorted(i for i, name in needles if len(joined(name)) >= shortest and any(f" {joined(name)} " in f" {t} " for t in said))


def made(seed, n_names, n_texts):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdef") * rng.randrange(1, 3)
    needles = [(i, rng.choice([" ", "-", ", "]).join(word() for _ in range(rng.randrange(6)))) for i in range(n_names)]
    texts = [None if rng.random() < 0.05 else " ".join(word() if rng.random() < 0.8 else "else" for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(n_texts)]
    return needles, texts


@pytest.mark.parametrize("seed", range(5))
def test_automaton_equals_search(seed):
    needles, texts = made(seed, 200, 1)
    names = sorted({joined(n) for _, n in needles} - {""})
    automaton = mentions.Automaton([n.split() for n in names])
    rng, text = random.Random(seed), ""
    while len(text) < 4000:
        text += " " + rng.choice("abcdefx") * rng.randrange(1, 3)
    import pyarrow as pa

    ids, _ = automaton.numbers(pa.array([text.strip()]))
    found = set()
    automaton.scan(ids.tolist(), 0, set(), found)
    assert {names[i] for i in found} == {n for n in names if f" {n} " in f" {text.strip()} "}
    # of one state the shorter names on its chain are found too
    nested = mentions.Automaton([["a", "b", "c"], ["b", "c"], ["c"], ["b"], ["d"]])
    found = set()
    nested.scan([0, 1, 2], 0, set(), found)
    assert found == {0, 1, 2, 3}


@pytest.mark.parametrize("most", [1 << 18, 25])
def test_mentions_equal_search(spark, most):
    needles, texts = made(7, 120, 60)
    n = spark.createDataFrame(needles, "id long, name string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "at long, text string").repartition(4)
    assert sorted(r.id for r in mentions.mentioned(n, t, most_words=most).collect()) == plain(needles, texts)
    assert sorted(r.id for r in mentions.mentioned(n, t, 1, most_words=most).collect()) == plain(needles, texts, 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # borders lie between partitions too
    across = sorted(r.id for r in mentions.mentioned(n, t, order=("at",), most_words=most).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert across == plain(needles, texts, across=True) and len(across) > len(plain(needles, texts))


def test_no_names_and_no_texts(spark):
    n = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (4, "some name")], "id long, name string")
    t = spark.createDataFrame([(1, "has some"), (2, None), (3, ""), (4, "name in two")], "at long, text string")
    assert mentions.mentioned(n.where("id < 4"), t).count() == 0
    assert mentions.mentioned(n, t.limit(0), order=("at",)).count() == 0
    assert mentions.mentioned(n, t).count() == 0
    assert [r.id for r in mentions.mentioned(n, t, order=("at",)).collect()] == [4]


def test_texts_are_neither_shuffled_nor_broadcast(spark):
    n = spark.createDataFrame([(1, "some name")], "id long, name string")
    t = spark.range(100).selectExpr("concat('a text with some name ', id) as text")
    plan = mentions.mentioned(n, t)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "MapInArrow" in x)
    below = plan[plan.index(scan) :]
    assert "Exchange" not in below and "Range" in below


def test_a_task_numbers_few_texts_at_once(monkeypatch):
    import pickle
    from types import SimpleNamespace

    import pyarrow as pa

    automaton, sizes = mentions.Automaton([["some", "name"], *([f"w{i}", f"v{i}"] for i in range(5000))]), []
    inner = mentions.Automaton.numbers
    monkeypatch.setattr(mentions.Automaton, "numbers", lambda self, texts: sizes.append(len(texts)) or inner(self, texts))
    texts = ["said"] * 2000 + ["some", "name"] + ["said"] * 46 + ["w7 v7", "w8 v9"]
    got = [x for b in mentions._scan_texts(SimpleNamespace(value=automaton))(iter([pa.record_batch([texts], ["text"])])) for x in b.column("name").to_pylist()]
    assert got == [8] and max(sizes) <= 512 and sum(sizes) == len(texts)
    assert len(pickle.dumps([automaton.ends, automaton.fail, automaton.shorter])) < 10_001 * 3 * 4 + 1000  # four bytes a state


def test_scanned_texts_are_folded_only(spark):
    """Words of texts stand apart by anything but letters and digits, marks, other scripts and zero bytes too; no pattern runs over them in a plan."""
    names = [(i, n) for i, n in enumerate(("Red Stone", "stone wall", "äöü ß1", "wall red", "blue wall"))]
    texts = ["a\x00Red\x00STONE", "...stone\n\n(wall)!", "Äöü—ß1", "стена wall", "red", "", None, " wall", "blue"]
    needles = spark.createDataFrame(names, "id long, name string")
    found = mentions.mentioned(needles, spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(r.id for r in found.distinct().collect()) == [0, 1, 2]
    scan = found._jdf.queryExecution().optimizedPlan().toString()
    folded = scan[scan.index("MapInArrow") :]
    assert "[^a-z0-9]+" not in folded
