"""Ranks, digests, builds and streamed logs against plain Python."""

import hashlib
import json
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import evaluation, ranks
from corpuswright.sources import build, digest
from corpuswright.streaming import log


def test_ranks_equal_sorting(spark):
    rng = random.Random(1)
    groups = {
        "even": [rng.random() for _ in range(500)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 2.0, 3.0]) for _ in range(400)],
        "one": [7.0] * 50,
        "wide": [math.copysign(10.0 ** rng.randrange(-300, 309), rng.choice([1, -1])) for _ in range(200)] + [1.7e308, -1.7e308, 0.0],
        "single": [3.5],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for buckets in (4, 1024):
        got = {r.g: (r.low, r.mid, r.high) for r in ranks.at_shares(df, ["g"], "v", {"low": 0.0, "mid": 0.5, "high": 0.99}, buckets).collect()}
        assert got == {g: tuple(sorted(vs)[math.floor(len(vs) * q)] for q in (0.0, 0.5, 0.99)) for g, vs in groups.items()}
    asked = spark.createDataFrame([("even", "a", 499), ("even", "b", 500), ("one", "a", -1)], "g string, name string, rank long")
    assert [(r.g, r.name, r.value) for r in ranks.at_ranks(df, ["g"], "v", asked).collect()] == [("even", "a", max(groups["even"]))]


def test_mcnemar_equals_the_binomial_sum(spark):
    cases = [(a, b) for a in (0, 1, 3, 15, 16, 17, 40, 333) for b in (0, 1, 14, 16, 18, 99, 340, 1000)] + [(2400, 2600)]
    p = {(r.a, r.b): r.p for r in spark.createDataFrame(cases, "a long, b long").select("a", "b", evaluation.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()}
    for a, b in cases:
        n, k = a + b, min(a, b)
        want = min(1.0, float(2 * Fraction(sum(math.comb(n, i) for i in range(k + 1)), 2**n)))
        assert abs(p[a, b] - want) <= 1e-12 * want + 1e-300
    # of a thousand million coins the normal approximation with its correction is as good
    large = spark.range(1).select(evaluation.mcnemar(F.lit(10**9 // 2 - 30000), F.lit(10**9 // 2 + 30000)).alias("p")).first().p
    assert abs(large - math.erfc((30000 - 0.5) / math.sqrt(10**9 / 4) / math.sqrt(2))) < 1e-7


def rows_of(spark, n, parts, change=()):
    df = spark.range(n).select("id", F.concat(F.lit("row "), "id").alias("text"), F.when(F.col("id") % 5 != 0, F.col("id") * 1.5).alias("x")).repartition(parts)
    return df.withColumn("text", F.when(F.col("id").isin(*change), "other").otherwise(F.col("text"))) if change else df


def test_digest_depends_on_rows_alone(spark):
    roots = {digest.root(rows_of(spark, 700, parts), "id") for parts in (1, 7, 64)}
    assert len(roots) == 1
    leaf = lambda i: hashlib.sha256(json.dumps({"id": i, "text": f"row {i}", "x": i * 1.5 if i % 5 else None}, separators=(",", ":")).encode()).hexdigest()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    nodes = [(sha(str(i)), leaf(i)) for i in range(700)]
    for digits in (4, 2, 0):
        above = {}
        for p, d in sorted(nodes):
            above.setdefault(p[:digits], []).append(f"{p}:{d}")
        nodes = [(p, sha(",".join(x))) for p, x in above.items()]
    assert roots == {nodes[0][1]}
    assert digest.root(rows_of(spark, 0, 1), "id") == sha("")


def test_a_changed_row_is_named(spark):
    kept = rows_of(spark, 700, 3)
    now = rows_of(spark, 700, 5, change=(42, 600)).where("id <> 7").unionByName(rows_of(spark, 701, 1).where("id = 700"))
    got = sorted(tuple(r) for r in digest.changed_rows(kept, now, "id").collect())
    assert got == [(7, "missing"), (42, "changed"), (600, "changed"), (700, "added")]
    assert digest.differing(digest.tree(kept, "id"), digest.tree(kept.repartition(9), "id")).count() == 0


def made(spark, path, leak=False, orphan=False, twice=False):
    cards = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(20)], "id string, text string")
    rows = [("train", f"r{i}", f"q{i}", f"c{i}") for i in range(15)] + [("test", "t0", "q3" if leak else "other", "c99" if orphan else "c1"), ("test", "t1", "more", None)]
    table = spark.createDataFrame(rows + rows[:1] * twice, "split string, id string, question string, card string")

    def overlap(t):
        seen = t["rows"].where("split = 'train'").select("question")
        return t["rows"].where("split <> 'train'").join(seen, "question", "left_semi").select("id")

    return build.Build(spark, path, {"cards": cards, "rows": table}, {"cards": ["id"], "rows": ["split", "id"]}, [("rows", ["card"], "cards", ["id"])], {"question in training": overlap})


KEYS = {"cards": "id", "rows": "id"}


def test_build_is_published_as_a_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/corpus"
    with pytest.raises(FileNotFoundError):
        build.current(spark, path)
    first = made(spark, path).commit(KEYS, {"prompt": "p"})
    assert first["tables"]["rows"]["rows"] == 17 and first["prompt"] == "p"
    for fault, names in (("leak", {"question in training"}), ("orphan", {"rows: no such cards"}), ("twice", {"rows: repeated key"})):
        with pytest.raises(build.BuildError) as e:
            made(spark, path, **{fault: True}).commit(KEYS)
        assert set(e.value.faults) == names
        assert build.current(spark, path)[1] == first
    tables, _ = build.current(spark, path)
    assert tables["rows"].count() == 17 and tables["cards"].count() == 20
    build.verify(spark, path, KEYS)
    second = made(spark, path).commit(KEYS)
    assert second["tables"] == first["tables"] and second["version"] != first["version"]
    assert build.sweep(spark, path) == [first["version"]] and build.sweep(spark, path) == []
    spark.createDataFrame([("train", "x", "q", None)], "split string, id string, question string, card string").write.mode("append").parquet(f"{path}/{second['version']}/rows")
    with pytest.raises(build.BuildError, match="rows"):
        build.verify(spark, path, KEYS)


def test_streamed_changes_after_restarts_equal_one_run(spark, tmp_path):
    rng, schema = random.Random(4), "id string, step long, answer string"
    rows = [(f"k{rng.randrange(12)}", n if rng.random() > 0.2 else rng.randrange(n + 1), f"v{n}") for n in range(60)]
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [("k0", None, "no step")]
    folder, seen = f"file://{tmp_path}/log", 0
    for n in range(3):  # stopped and started again twice
        log.append(spark.createDataFrame(rows[n::3], schema).coalesce(1), folder)
        log.keep_latest(log.read_log(spark, folder, schema), ["id"], "step", f"file://{tmp_path}/changes", f"file://{tmp_path}/check").awaitTermination()
        changes = spark.read.parquet(f"file://{tmp_path}/changes").count()
        assert changes - seen <= len(rows[n::3])
        seen = changes
    log.keep_latest(log.read_log(spark, folder, schema), ["id"], "step", f"file://{tmp_path}/once", f"file://{tmp_path}/check-once").awaitTermination()
    want = {}
    for k, step, answer in rows:
        if step is not None and (k not in want or step > want[k][0]):
            want[k] = (step, answer)
    for table in ("changes", "once"):
        assert {r.id: (r.step, r.answer) for r in log.latest(spark, f"file://{tmp_path}/{table}", ["id"], "step").collect()} == want
    again = spark.read.parquet(f"file://{tmp_path}/changes").count()
    log.keep_latest(log.read_log(spark, folder, schema), ["id"], "step", f"file://{tmp_path}/changes", f"file://{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/changes").count() == again


def test_streamed_keys_share_the_states_of_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "BUCKETS", 2)
    big, schema = (1 << 53) + 1, "id long, kind string, step long, amount long"
    folder, held = f"file://{tmp_path}/log", []
    parts = [[(i, None if i % 5 == 0 else "x", 5, big) for i in range(30)], [(None, "x", 1, None), (big, "x", 3, big), (0, None, 5, 7), (1, "x", 4, 7), (2, "x", 6, None), (2, "x", 7, big)]]
    for part in parts:
        log.append(spark.createDataFrame(part, schema).coalesce(1), folder)
        stream = log.keep_latest(log.read_log(spark, folder, schema), ["id", "kind"], "step", f"file://{tmp_path}/changes", f"file://{tmp_path}/check")
        stream.awaitTermination()
        held.append(stream.lastProgress["stateOperators"][0]["numRowsTotal"])
    want = {(i, None if i % 5 == 0 else "x"): (5, big) for i in range(30)} | {(None, "x"): (1, None), (big, "x"): (3, big), (2, "x"): (7, big)}
    assert {(r.id, r.kind): (r.step, r.amount) for r in log.latest(spark, f"file://{tmp_path}/changes", ["id", "kind"], "step").collect()} == want
    assert spark.read.parquet(f"file://{tmp_path}/changes").count() == 33  # an older or equal step is no news
    assert max(held) <= 2, held  # a state a bucket, so a call in Python each, not for each key
