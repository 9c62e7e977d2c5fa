"""Gap sessionisation by a speculative parallel scan.

1. Clicks, one of each id, are range-partitioned by client and time and sorted, so a client of any size is spread
   over as many partitions as its clicks fill. Every partition is scanned at once, on the guess that no session is
   open where it begins.
2. A partition's head is what comes before its first certain cut: a cut that holds whatever came before the
   partition (the click before it, in the same partition, is final or too long ago, or the client changes). After it
   all sessions are certain. The head's sessions are guesses; its clicks are kept for another run.
3. Every partition tells its end's state (client, session, last click) to the next by a join on the partition's number.
   A partition without a certain cut whose guess was wrong is run again from the true state, and tells its
   new end, until no state changes. Then the heads whose guess was wrong are run again; the other guesses stand.
4. A session that crosses partitions is left in pieces (sums and the ids of its clicks in order), which are put
   together by session.

The scan's results are a table in the shared folder; states are joined, never collected or broadcast, and one number a round
goes to the driver. The scan holds one session's ids, in pieces of at most ``piece_ids``. A chain of partitions without any
certain cut takes a round for each of them at worst: only a client that never pauses and never ends makes one.

Defined results: rows without click_id, client_id or ts are left out, and of rows with one click_id the least (by
client, ts, arrival, kind, value) stays; without arrived_at a click isn't late; null, NaN and infinite values count
0 cents and are not final unless they reach the limit (NaN and infinity do, as the greatest values); late clicks
before a client's first session, or of a client without one, are in none; an empty table gives an empty one. Other columns
are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

_FLUSH_ROWS = 8192


@dataclass(frozen=True)
class Params:
    gap_minutes: int = 10
    length_minutes: int = 40
    late_minutes: int = 360
    final_kind: str = "error"
    final_value: float = 60
    #: ids of a session that a scan holds at once; memory, never the result
    piece_ids: int = 1 << 14


#: Rows of a scan. kind: "session" (whole), "piece" (of a session that crosses partitions), "click" (of a head), "state" (of
#: a partition's end). ``head`` marks what depends on the guess.
SCAN = (
    "part int, seq long, kind string, head boolean, client_id long, session_id long, start_us long, end_us long, n_clicks long, "
    "n_late long, value_cents long, closed_by string, final boolean, path string, first_client long, soft boolean, late boolean"
)
_NAMES = [c.split()[0] for c in SCAN.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in SCAN.split(", ")]
_SCHEMA = pa.schema(list(zip(_NAMES, _TYPES)))
SESSIONS = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string"
_STATE = ["client_id", "session_id", "start_us", "end_us", "final"]


def events(clicks: DataFrame, p: Params = Params()) -> DataFrame:
    """(client_id, ts, click_id, late, final, cents), one row of each click."""
    kept = clicks.where("click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL")
    late = F.coalesce(F.expr(f"arrived_at - ts > interval '{p.late_minutes}' minute"), F.lit(False))
    final = F.coalesce((F.col("value") >= p.final_value) & (F.col("kind") == p.final_kind), F.lit(False))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < 9e15)
    cents = F.when(finite, F.floor(100 * F.col("value") + 0.5)).otherwise(0).cast("long")
    once = kept.groupBy("click_id").agg(F.min(F.struct("client_id", "ts", "arrived_at", "kind", "value")).alias("r")).select("click_id", "r.*")
    return once.select("client_id", "ts", "click_id", late.alias("late"), final.alias("final"), cents.alias("cents"))


class _Open:
    """The session that a scan is in; ``whole`` while all of it is still here."""

    __slots__ = ("client", "id", "start", "end", "final", "whole", "here", "clicks", "late", "cents", "ids")

    def __init__(self, client: int, id_: int, start: int, end: int, final: bool, whole: bool) -> None:
        self.client, self.id, self.start, self.end, self.final, self.whole = client, id_, start, end, final, whole
        self.here = self.clicks = self.late = self.cents = 0
        self.ids: list[str] = []


class Scan:
    """One partition's scan, from an open session or none; rows of SCAN are gathered in ``rows``."""

    def __init__(self, part: int, p: Params, held: _Open | None = None, keep_head: bool = True) -> None:
        self.part, self.open, self.keep_head = part, held, keep_head
        self.piece_ids = p.piece_ids
        self.gap, self.length = p.gap_minutes * 60_000_000, p.length_minutes * 60_000_000
        self.client = self.first = held.client if held else None
        self.head, self.seq, self.rows = True, 0, []

    def _add(self, kind: str, *values: object) -> None:
        self.rows.append((self.part, self.seq, kind, self.head, *values))
        self.seq += 1

    def _piece(self, s: _Open, reason: str | None) -> None:
        self._add("piece", s.client, s.id, s.start, s.end, s.clicks, s.late, s.cents, reason, s.final, ",".join(s.ids), None, None, None)
        s.whole, s.clicks, s.late, s.cents, s.ids = False, 0, 0, 0, []

    def _close(self, reason: str | None) -> None:
        s, self.open = self.open, None
        if s is None:
            return
        reason = reason or ("end" if s.final else "none")
        if s.whole:
            path = hashlib.sha256(",".join(s.ids).encode()).hexdigest()
            self._add("session", s.client, s.id, s.start, s.end, s.clicks, s.late, s.cents, reason, s.final, path, None, None, None)
        else:
            self._piece(s, reason)

    def click(self, client: int, us: int, id_: int, late: bool, final: bool, cents: int) -> bool:
        """Takes the next click in order of client and time; true while in the head."""
        if self.head and self.keep_head:
            self._add("click", client, id_, us, None, None, None, cents, None, final, None, None, None, late)
        if client != self.client:
            self._close(None)
            self.head = self.head and self.client is None
            self.client = client
            if self.first is None:
                self.first = client
        s = self.open
        if late:
            if s is not None:
                s.late += 1
            return self.head
        if s is not None:
            reason = "end" if s.final else "gap" if us - s.end >= self.gap else "length" if us - s.start > self.length else None
            if reason is None:
                s.end, s.final = us, final
                s.here += 1
                s.clicks += 1
                s.cents += cents
                s.ids.append(str(id_))
                if len(s.ids) >= self.piece_ids:
                    self._piece(s, None)
                return self.head
            certain = reason != "length" and s.here > 0
            self._close(reason)
            self.head = self.head and not certain
        s = self.open = _Open(client, id_, us, us, final, True)
        s.here, s.clicks, s.cents, s.ids = 1, 1, cents, [str(id_)]
        return self.head

    def finish(self) -> None:
        """The open session's last piece, and the state for the next partition."""
        s, empty = self.open, (None,) * 5
        if s is not None:
            self._piece(s, None)
            empty = (s.id, s.start, s.end, None, None)
        self._add("state", self.client, *empty, None, None, s.final if s is not None else None, None, self.first, self.head, None)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], schema=_SCHEMA)


def _scan(p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, some = Scan(TaskContext.get().partitionId(), p), False
        for b in batches:
            us = b.column("ts").cast(pa.int64())
            for row in zip(*(c.to_pylist() for c in (b.column("client_id"), us, b.column("click_id"), b.column("late"), b.column("final"), b.column("cents")))):
                some = True
                scan.click(*row)
            if len(scan.rows) >= _FLUSH_ROWS:
                yield scan.take()
        if some:
            scan.finish()
            yield scan.take()

    return run


def _again(p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Heads of partitions, each after the state that it begins with (seq -1), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, done, out = None, True, []

        def end() -> None:
            if scan is not None:
                if not done:  # no certain cut: the session is open at the partition's end
                    scan.finish()
                out.append(scan.take())

        for b in batches:
            for r in b.to_pylist():
                if scan is None or r["part"] != scan.part:
                    end()
                    held = None
                    if r["seq"] < 0 and r["session_id"] is not None:
                        held = _Open(r["client_id"], r["session_id"], r["start_us"], r["end_us"], r["final"], False)
                    scan, done = Scan(r["part"], p, held, keep_head=False), False
                if r["seq"] >= 0 and not done:
                    done = not scan.click(r["client_id"], r["start_us"], r["session_id"], r["late"], r["final"], r["value_cents"])
            if scan is not None and len(scan.rows) >= _FLUSH_ROWS:
                out.append(scan.take())
            yield from out
            out.clear()
        end()
        yield from out

    return run


def speculate(clicks: DataFrame, p: Params = Params()) -> DataFrame:
    """The scan of every partition on the guess of a fresh start, as a table of SCAN."""
    order = ["client_id", "ts", "late", "click_id"]  # late clicks after timely ones of their time
    return scratch.cut(events(clicks, p).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan(p), SCAN), "sessions-scan")


def rerun(scanned: DataFrame, carried: DataFrame, p: Params = Params()) -> DataFrame:
    """The heads of the partitions in ``carried`` (part, state), run again from those states."""
    heads = scanned.where("kind = 'click'").join(carried.select("part").hint("merge"), "part", "left_semi")
    given = carried.select("part", *_STATE)
    state = given.select(*(F.lit(-1).cast("long").alias("seq") if c == "seq" else F.col(c) if c in given.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCAN.split(", "))))
    return heads.select(*_NAMES).unionByName(state).repartition("part").sortWithinPartitions("part", "seq").mapInArrow(_again(p), SCAN)


def settle(scanned: DataFrame, p: Params = Params()) -> DataFrame:
    """(part, state): the true state with which every partition begins whose guess was wrong."""
    ends = scanned.where("kind = 'state'").select("part", "first_client", "soft", *_STATE)
    # what a partition was last run with; the first scan's guess is no session
    known = scratch.cut(ends.select("*", *(F.lit(None).cast(t).alias(f"was_{c}") for c, t in ends.select(*_STATE).dtypes)), "sessions-states")
    while True:
        before = known.select((F.col("part") + 1).alias("part"), *(F.col(c).alias(f"new_{c}") for c in _STATE))
        met = known.join(before.hint("merge"), "part", "left")
        # another client's session is none here
        ours = F.col("new_session_id").isNotNull() & (F.col("new_client_id") == F.col("first_client"))
        told = met.select(*known.columns, *(F.when(ours, F.col(f"new_{c}")).alias(f"new_{c}") for c in _STATE))
        same = [F.col(f"was_{c}").eqNullSafe(F.col(f"new_{c}")) for c in _STATE]
        differs = ~(same[0] & same[1] & same[2] & same[3] & same[4])
        told = scratch.cut(told.select("*", differs.alias("differs")), "sessions-told")
        moved = told.where("soft AND differs").select("part", *(F.col(f"new_{c}").alias(c) for c in _STATE))
        if moved.isEmpty():
            scratch.drop(known)
            return told.where("new_session_id IS NOT NULL").select("part", *(F.col(f"new_{c}").alias(c) for c in _STATE))
        ended = rerun(scanned, moved, p).where("kind = 'state'").select("part", *(F.col(c).alias(f"end_{c}") for c in _STATE))
        fresh = told.join(ended.withColumn("run", F.lit(True)).hint("merge"), "part", "left")
        run = F.col("run").isNotNull()
        after = scratch.cut(
            fresh.select(
                "part", "first_client", "soft",
                *(F.when(run, F.col(f"end_{c}")).otherwise(F.col(c)).alias(c) for c in _STATE),
                *(F.when(run, F.col(f"new_{c}")).otherwise(F.col(f"was_{c}")).alias(f"was_{c}") for c in _STATE),
            ),
            "sessions-states",
        )
        scratch.drop(known, told)
        known = after


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sessions of their pieces, which come in order; the digest runs on from piece to piece."""
    names = [c.split()[0] for c in SESSIONS.split(", ")]
    now, digest, filled, out = None, None, False, []

    def row() -> dict:
        now["closed_by"] = now["closed_by"] or ("end" if now["final"] else "none")
        return {c: digest.hexdigest() if c == "path_sha256" else now[c] for c in names}

    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SESSIONS.split(", ")])
    for b in batches:
        for r in b.to_pylist():
            if now is None or r["session_id"] != now["session_id"]:
                if now is not None:
                    out.append(row())
                now, digest, filled = r, hashlib.sha256(), False
            else:
                for c in ("n_clicks", "n_late", "value_cents"):
                    now[c] += r[c]
                now["end_us"], now["final"], now["closed_by"] = r["end_us"], r["final"], now["closed_by"] or r["closed_by"]
            if r["path"]:
                digest.update((("," if filled else "") + r["path"]).encode())
                filled = True
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def sessionise(clicks: DataFrame, p: Params = Params()) -> DataFrame:
    """Sessions of ``clicks`` (click_id, ts, arrived_at, client_id, kind, value), columns as in SESSIONS."""
    scanned = speculate(clicks, p)
    wrong = scratch.cut(settle(scanned, p), "sessions-wrong")
    again = scratch.cut(rerun(scanned, wrong, p), "sessions-again")
    certain = scanned.where("NOT head AND kind IN ('session', 'piece')")
    guessed = scanned.where("head AND kind IN ('session', 'piece')").join(wrong.select("part").hint("merge"), "part", "left_anti").select(*_NAMES)
    parts = certain.unionByName(guessed).unionByName(again.where("kind IN ('session', 'piece')"))
    columns = [c.split()[0] for c in SESSIONS.split(", ")]
    whole = parts.where("kind = 'session'").withColumnRenamed("path", "path_sha256").select(*columns)
    pieces = parts.where("kind = 'piece'").select("part", "seq", "client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "final", "path")
    joined = pieces.repartition("session_id").sortWithinPartitions("session_id", "part", "seq").mapInArrow(_join_pieces, SESSIONS)
    return whole.unionByName(joined)


def op12_sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionise(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


#: Islands of clicks without an end or a gap, then cuts by length within each, one after the other.
OP12_SQL = """
WITH RECURSIVE once AS (
  SELECT DISTINCT ON (click_id) click_id, client_id, epoch_us(ts) AS us, epoch_us(arrived_at) - epoch_us(ts) > 21600000000 AS late,
         coalesce(value >= 60 AND kind = 'error', false) AS final, coalesce(floor(100 * value + 0.5)::BIGINT, 0) AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL),
timely AS (
  SELECT *, row_number() OVER w AS n, lag(final) OVER w AS was_final, us - lag(us) OVER w AS pause
  FROM once WHERE NOT coalesce(late, false) WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
marked AS (
  SELECT *, sum((n = 1 OR was_final OR pause >= 600000000)::INT) OVER (PARTITION BY client_id ORDER BY n) AS island FROM timely),
cuts AS (
  SELECT client_id, island, min(n) AS n, arg_min(us, n) AS us FROM marked GROUP BY client_id, island
  UNION ALL
  SELECT c.client_id, c.island, min(m.n), arg_min(m.us, m.n) FROM cuts c JOIN marked m ON m.client_id = c.client_id AND m.island = c.island AND m.us - c.us > 2400000000
  GROUP BY c.client_id, c.island),
numbered AS (
  SELECT m.*, max(CASE WHEN c.n IS NOT NULL THEN m.n END) OVER (PARTITION BY m.client_id ORDER BY m.n) AS from_n, c.n IS NOT NULL AS begins
  FROM marked m LEFT JOIN cuts c ON m.client_id = c.client_id AND m.n = c.n),
sessions AS (
  SELECT client_id, from_n, arg_min(click_id, n) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, sum(cents)::BIGINT AS value_cents,
         arg_max(final, n) AS last_final, max(n) AS last_n, sha256(string_agg(click_id::VARCHAR, ',' ORDER BY n)) AS path_sha256
  FROM numbered GROUP BY client_id, from_n),
bounded AS (SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY from_n) AS next_us FROM sessions),
lates AS (
  SELECT b.client_id, b.from_n, count(*) AS n_late FROM bounded b JOIN once o ON o.client_id = b.client_id AND o.late AND o.us >= b.start_us AND (b.next_us IS NULL OR o.us < b.next_us)
  GROUP BY b.client_id, b.from_n)
SELECT b.client_id, b.session_id, b.start_us, b.end_us, b.n_clicks, coalesce(l.n_late, 0) AS n_late, b.value_cents,
       CASE WHEN last_final THEN 'end' WHEN m.n IS NULL THEN 'none' WHEN m.pause >= 600000000 THEN 'gap' ELSE 'length' END AS closed_by, b.path_sha256
FROM bounded b LEFT JOIN lates l ON l.client_id = b.client_id AND l.from_n = b.from_n LEFT JOIN marked m ON m.client_id = b.client_id AND m.n = b.last_n + 1
"""
