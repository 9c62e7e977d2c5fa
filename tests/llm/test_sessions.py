import hashlib
import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest

from corpuswright.llm import sessions

EPOCH = datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double"


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def plain(rows, p=sessions.Params()):
    once = {}
    for r in rows:
        if None not in r[:2] and r[3] is not None:
            once.setdefault(r[0], r)
    out, minute = [], 60_000_000
    for client in {r[3] for r in once.values()}:
        own = sorted((us(r[1]), r[0], r) for r in once.values() if r[3] == client)
        late = [t for t, _, r in own if r[2] is not None and us(r[2]) - t > p.late_minutes * minute]
        timely = [x for x in own if not (x[2][2] is not None and us(x[2][2]) - x[0] > p.late_minutes * minute)]
        found, final = [], False
        for t, i, r in timely:
            reason = None
            if found:
                reason = "end" if final else "gap" if t - found[-1]["last"] >= p.gap_minutes * minute else "length" if t - found[-1]["start"] > p.length_minutes * minute else None
                if reason:
                    found[-1]["by"] = reason
            if not found or reason:
                found.append({"start": t, "ids": [], "cents": 0, "by": None})
            s = found[-1]
            value = r[5]
            final = value is not None and (value >= p.final_value or math.isnan(value)) and r[4] == p.final_kind
            s["last"], s["final"] = t, final
            s["ids"].append(i)
            s["cents"] += math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        for n, s in enumerate(found):
            until = found[n + 1]["start"] if n + 1 < len(found) else math.inf
            path = hashlib.sha256(",".join(map(str, s["ids"])).encode()).hexdigest()
            by = s["by"] or ("end" if s["final"] else "none")
            out.append((client, s["ids"][0], s["start"], s["last"], len(s["ids"]), sum(s["start"] <= t < until for t in late), s["cents"], by, path))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def dense(rng, n, clients, step, final=0.02, late=0.05):
    """Clicks of a few clients; client 0 has half of them and pauses seldom."""
    at, rows = {}, []
    for i in range(n):
        client = 0 if rng.random() < 0.5 else rng.randrange(clients)
        at[client] = at.get(client, datetime(2024, 1, 1)) + timedelta(seconds=rng.choice([0, rng.expovariate(1 / step), rng.expovariate(1 / step)]), microseconds=rng.choice([0, 0, 1]))
        kind, value = rng.choice(["view", "error", None]), rng.choice([None, 59.99, 60.0, -3.005, 1e3])
        if kind == "error" and value is not None and rng.random() > 3 * final:
            value = 1.0
        lag = timedelta(minutes=rng.choice([360, 361, 5000])) if rng.random() < late else timedelta(seconds=1)
        rows.append((i, at[client], at[client] + lag, client, kind, value))
    rng.shuffle(rows)
    return rows + rng.sample(rows, n // 10)


@pytest.fixture
def spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed, step, final", [(1, 60, 0.02), (2, 90, 0.0), (3, 400, 0.1)])
def test_equals_brute_force(spread, seed, step, final):
    rows = dense(random.Random(seed), 3000, 30, step, final)
    df = spread.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows)
    assert got(sessions.sessionise(df)) == want
    assert {r[7] for r in want} >= {"length", "none"}
    assert got(sessions.sessionise(df, sessions.Params(piece_ids=3))) == want


def test_partitions_without_a_certain_cut(spread):
    """One client that never pauses: every partition is run again from the one before, round by round."""
    rng, at, rows = random.Random(5), datetime(2024, 2, 1), []
    for i in range(800):
        at += timedelta(seconds=rng.choice([1, 150, 280]))
        rows.append((i, at, at + timedelta(hours=7) if i % 50 == 7 else at, 4, "view", 1.25))
    df = spread.createDataFrame(rows, SCHEMA)
    scanned = sessions.speculate(df)
    ends = scanned.where("kind = 'state'").collect()
    assert len(ends) > 5 and all(r.soft for r in ends)
    want = plain(rows)
    assert got(sessions.sessionise(df)) == want and {r[7] for r in want} == {"length", "none"}
    longer = sessions.Params(length_minutes=10**6, piece_ids=7)  # one session over all partitions
    assert got(sessions.sessionise(df, longer)) == plain(rows, longer) and len(plain(rows, longer)) == 1


def test_partitions_of_late_clicks_only(spread):
    at = datetime(2024, 3, 1)
    rows = [(i, at + timedelta(seconds=i % 300), at + timedelta(days=3), 1, "view", 1.0) for i in range(600)]
    rows += [(1000, at, at, 1, "view", 2.0), (1001, at + timedelta(seconds=299), at, 1, "error", 70.0), (1002, at - timedelta(days=1), at + timedelta(days=5), 1, "view", 1.0)]
    assert got(sessions.sessionise(spread.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_odd_rows(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, at, at, 1, "error", 60.0), (1, at, at, 1, "error", 60.0), (2, at, at, 1, "view", 60.0), (3, at, None, 1, None, None),
        (4, None, at, 1, "view", 1.0), (5, at, at, None, "view", 1.0), (None, at, at, 1, "view", 1.0), (6, at, at, 2, "error", float("nan")),
        (7, at, at, 2, "view", float("inf")), (8, at, at + timedelta(minutes=360), 3, "view", 0.125), (9, at, at + timedelta(minutes=360, microseconds=1), 4, "view", 1.0),
        (10, at + timedelta(minutes=10), at, 3, "view", 0.005), (11, at + timedelta(minutes=50), at, 2, "error", 61.0),
        (12, at, at, 1, "error", 99.0), (13, at + timedelta(seconds=1), at + timedelta(days=1), 1, "error", 99.0), (14, at, at + timedelta(days=1), 1, "view", 1.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "'x' as path", "2 as session_id", "true as late", "3 as CLIENT")
    assert got(sessions.sessionise(df)) == plain(rows)
    assert sessions.sessionise(df.limit(0)).count() == 0
    zoned = df.withColumn("ts", df.ts.cast("timestamp")).withColumn("arrived_at", df.arrived_at.cast("timestamp"))
    assert got(sessions.sessionise(zoned)) == plain(rows)


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    found = got(sessions.op12_sessionise(spark, sf_dir))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW clicks AS SELECT * FROM '{sf_dir}/clicks.parquet'")
    assert found == sorted(tuple(r) for r in c.execute(sessions.OP12_SQL).fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/clicks.parquet").select("click_id", "ts", "arrived_at", "client_id", "kind", "value").collect()]
    assert found == plain(rows)
    names = spark.read.parquet(f"{sf_dir}/clicks.parquet").columns
    assert "ts" in names and sessions.op12_sessionise(spark, sf_dir).columns == ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256"]
