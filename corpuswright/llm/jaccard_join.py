"""Exact n-gram Jaccard join with adaptive multi-match prefixes, and its components.

A document is the set of its distinct shingles (runs of ``k`` words, hashed to 64 bits); two
documents link if the Jaccard similarity of their sets reaches ``percent``.

Prefixes. All shingles have one global order, from rare to frequent by a sketch of the whole
corpus (counts of shingles in ``sketch_width`` cells), then by hash. Documents that link share at
least ``ceil(percent * n)`` of a document's n shingles, so the first ``n - that + l`` shingles of both
have at least l in common, for any l. Each document chooses its own l: for every candidate length it
estimates from the sketch how many postings its prefix has and how many documents would share l of
them, and takes the cheapest. Two documents are then candidates only if their prefixes share as many
shingles as the smaller of their l asks for. No l is below a floor that grows with the size (``least_matches``):
passages that two documents share are too few for it, also where a sketch of fixed size no longer
tells shingles that few documents have from those that one has. A class that shares fewer of its prefix than
it and all possible partners ask for is dropped before any pair is made. The order and the choice of l only
change the cost: the result is exact for any sketch.

Groups of copies. Documents with equal sets are one class, told apart by a 64-bit hash of the set;
each task lists a class once, so a hot group of copies sends no more postings than there are
tasks. Shingles whose cell stands out from the sketch's mean are salted by their frequency. Near copies are not
all paired with each other. Each document is measured against a hub, the most central document of its
runs, and against the root of its family, which is the hub's own hub and so on. For documents of one root, what
a pair can share is bounded by their overlaps with the root, so only pairs are left that share some
shingle which the root lacks: in a group of near copies, those with an edit in common, if not both link
with the root. For documents of different roots, the shingles are left that occur in several families, and their pairs
are checked against both l. A pair whose documents are known to be connected needs no check.
No link between components is lost.

Measuring. Every class has a parity signature: a bit for each cell of about as many cells as it has
shingles, the parity of its shingles there. A shingle that only one of two sets has flips one bit, so
the bits in which two signatures differ are at most the symmetric difference, and pairs that differ
in more than a link allows are dropped exactly. Only what is left reads whole texts again; a
Bloom filter of their ids keeps other texts out of the shuffle, as an optimisation; exact membership is checked
by the join after it.

Tables between steps are in the shared folder. Nothing but the sketch and the Bloom filter is collected; the sketch is of
fixed size, the filter has a size by count up to ``bloom_bits``.

Defined results: a text without words, or null, has no shingle, links with nothing and is its own
component; a text with fewer than ``k`` words has all its words as one shingle; rows with a null
doc_id link with nothing and have a null component; rows that repeat an id are documents of their own
with one id, and their components meet only through links; an empty table gives an empty table.
Columns beside doc_id and text are left out of the query; ``keep_one`` keeps them, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from . import textkit as tk
from .components import components


@dataclass(frozen=True)
class Params:
    k: int = 5
    percent: int = 75
    sketch_width: int = 1 << 20
    verify_cost: float = 20.0
    spread: int = 6
    hot_run: int = 1024
    bloom_bits: int = 1 << 26


SKETCH_BLOCKS = 32


@dataclass
class Sets:
    """Distinct shingles of a block of texts, ascending within each text."""

    values: np.ndarray
    ptr: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ptr)

    def ids(self) -> np.ndarray:
        """A 64-bit hash of each set, signed as Spark's longs are; 0 for an empty one."""
        total = np.zeros(len(self.values) + 1, tk.U64)
        np.cumsum(tk.mix(self.values ^ tk.U64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
        h = tk.mix((total[self.ptr[1:]] - total[self.ptr[:-1]]) ^ (self.sizes.astype(tk.U64) * tk.U64(0xC2B2AE3D27D4EB4F)))
        return np.where(self.sizes > 0, h, tk.U64(0)).view(np.int64)

    def parities(self) -> pa.ListArray:
        """A signature for each set: 64-bit words, as many bits as the next power of two of its size (64 to 8192)."""
        sizes = self.sizes
        words = np.where(sizes > 0, 1 << np.clip(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) - 6, 0, 7), 0)
        begin = np.concatenate([[0], np.cumsum(words)])
        own = tk.owners(self.ptr)
        cell = (tk.mix(self.values) & (64 * words[own] - 1).astype(tk.U64)).astype(np.int64)
        odd = np.bincount(64 * begin[own] + cell, minlength=64 * int(begin[-1])) & 1
        packed = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
        return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(packed))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> Sets:
    low = tk.LOWER[buf]
    starts, ends, ptr = tk.split(low, offs, tk.SPACES)
    g, own = tk.shingles(tk.hash_ranges(low, starts, ends), ptr, k)
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    g, own = g[first], own[first]
    return Sets(g, np.searchsorted(own, np.arange(len(offs))))


def _cells(g: np.ndarray, width: int) -> np.ndarray:
    return (g >> tk.U64(20)).astype(np.int64) % width


def survey(docs: DataFrame, p: Params) -> DataFrame:
    """Rows of two kinds: (doc_id, set_id, n, parity) of every document, and (block, counts) parts of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(p.sketch_width, np.uint32)
        seen = np.zeros(0, np.int64)
        for b in batches:
            for first, last, buf, offs in tk.blocks(b.column("text")):
                sets = shingle_sets(buf, offs, p.k)
                ids, n = sets.ids(), last - first
                # a class counts once a block: copies don't make their shingles look frequent
                fresh = np.zeros(n, bool)
                fresh[np.unique(ids, return_index=True)[1]] = True
                fresh &= ~np.isin(ids, seen)
                seen = np.concatenate([seen[-65536:], ids[fresh]])
                sketch += np.bincount(_cells(sets.values[np.repeat(fresh, sets.sizes)], p.sketch_width), minlength=p.sketch_width).astype(np.uint32)
                none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), pa.array(ids), pa.array(sets.sizes.astype(np.int64)), sets.parities(), *none], names=["doc_id", "set_id", "n", "parity", "block", "counts"])
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, SKETCH_BLOCKS)] if sketch.any() else []
        none = [pa.nulls(len(parts), pa.int64())] * 3 + [pa.nulls(len(parts), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "set_id", "n", "parity", "block", "counts"])

    return scratch.cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id long, n long, parity array<long>, block int, counts binary"), "survey")


def read_sketch(surveyed: DataFrame, p: Params) -> np.ndarray:
    """The sketch of the whole corpus; its blocks are added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                x = np.frombuffer(zlib.decompress(counts), np.uint32)
                held[block] = held[block] + x if block in held else x
        yield pa.RecordBatch.from_pydict({"block": pa.array(held, pa.int32()), "counts": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    parts = surveyed.where("block IS NOT NULL").select("block", "counts").repartition(SKETCH_BLOCKS, "block").mapInArrow(run, "block int, counts binary").collect()
    out = np.zeros((SKETCH_BLOCKS, p.sketch_width // SKETCH_BLOCKS), np.uint32)
    for r in parts:
        out[r.block] = np.frombuffer(r.counts, np.uint32)
    return out.reshape(-1)


def least_matches(n: np.ndarray, p: Params) -> np.ndarray:
    """The floor of l for sets of n shingles; it never falls as n grows."""
    need = -(-p.percent * n // 100)
    spare = n - need
    return np.minimum(need, np.maximum(1, np.maximum(spare // 4, np.floor(np.sqrt(p.spread * spare)).astype(np.int64))))


def _least_matches(n: str, p: Params) -> str:
    """SQL: the same."""
    need = f"(({p.percent} * {n} + 99) div 100)"
    return f"least({need}, greatest(1, ({n} - {need}) div 4, cast(floor(sqrt({p.spread} * ({n} - {need}))) as bigint)))"


def noise(sketch: np.ndarray) -> float:
    """What the count of a cell may be without any frequent shingle in it."""
    return 1 + sketch.mean() + 4 * np.sqrt(sketch.mean())


#: Candidates for l, in halves of its floor.
STEPS = (2, 3, 4, 6, 8, 12)


def prefixes(sets: Sets, sketch: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, its estimated frequency) of all prefixes, and every text's number of matches l."""
    n, own = sets.sizes, tk.owners(sets.ptr)
    often = sketch[_cells(sets.values, p.sketch_width)].astype(np.int64)
    order = np.lexsort((sets.values, often, own))
    g, often = sets.values[order], often[order]
    need = -(-p.percent * n // 100)  # shingles shared with any partner, at least
    excess = np.maximum(0, often - noise(sketch))
    others = np.zeros(len(g) + 1, np.float64)
    np.cumsum(excess, out=others[1:])
    floor = least_matches(n, p)
    best, choice = np.full(len(n), np.inf), floor.copy()
    for step in STEPS:
        matches = np.minimum(need, floor * step // 2)
        length = n - need + matches
        cost = length + p.verify_cost * (others[sets.ptr[:-1] + length] - others[sets.ptr[:-1]]) / np.maximum(1, matches)
        better = cost < best
        best, choice = np.where(better, cost, best), np.where(better, matches, choice)
    length = n - need + choice
    inside = np.arange(len(g)) - sets.ptr[:-1][own] < length[own]
    return own[inside], g[inside], excess[inside], choice


#: Postings that a bucket of the shuffle holds, about.
BUCKET = 1 << 18
CHUNK = "bucket int, postings binary, salts binary, sets binary"
_SET = np.dtype([("set_id", "<i8"), ("n", "<i4"), ("matches", "<i4")])
SHARED = "shingle long, salt int, set_id long, n int, matches int"


def _buckets(g: np.ndarray, salts: np.ndarray, count: int) -> np.ndarray:
    return (tk.mix(g ^ (salts.astype(tk.U64) * tk.U64(0xC2B2AE3D27D4EB4F))) % tk.U64(count)).astype(np.int64)


def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, the distinct keys, and where each one's part begins and the last ends."""
    order = np.argsort(keys, kind="stable")
    found, begin = np.unique(keys[order], return_index=True)
    return order, found, np.append(begin, len(keys))


def postings(docs: DataFrame, sent: Broadcast, buckets: int, p: Params) -> DataFrame:
    """The prefixes of every class of equal sets, once a task at least, packed: a row for a bucket and a block of texts.

    ``postings`` are pairs of a shingle and a class, ``salts`` their salts if any has one; ``sets`` are
    classes with their size and l, in a bucket by their id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = sent.value, set()
        hot = p.hot_run + float(sketch.mean())
        for b in batches:
            for _, _, buf, offs in tk.blocks(b.column("text")):
                sets = shingle_sets(buf, offs, p.k)
                ids = sets.ids()
                fresh = np.zeros(len(ids), bool)
                for i, x in enumerate(ids.tolist()):
                    if x not in seen and sets.sizes[i]:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > 1_000_000:  # a class may then be listed again, which changes nothing
                    seen.clear()
                own, g, excess, matches = prefixes(sets, sketch, p)
                keep = fresh[own]
                own, g, excess = own[keep], g[keep], excess[keep]
                salts = np.where(excess > hot, (ids.view(tk.U64)[own] % (1 + excess // hot).astype(tk.U64)).astype(np.int64) + 1, 0)
                pairs = np.stack([g.view("<i8"), ids[own]], axis=1)
                listed = np.zeros(int(fresh.sum()), _SET)
                listed["set_id"], listed["n"], listed["matches"] = ids[fresh], sets.sizes[fresh], matches[fresh]
                rows: dict[int, list[bytes]] = {}
                for kind, keys, values in ((0, _buckets(g, salts, buckets), pairs), (2, _buckets(ids.view(tk.U64)[fresh], np.zeros(len(listed)), buckets), listed)):
                    order, found, cut = _parts(keys)
                    values, own_salts = values[order], salts[order] if kind == 0 else None
                    for k, x, y in zip(found.tolist(), cut, cut[1:]):
                        row = rows.setdefault(k, [b"", b"", b""])
                        row[kind] = values[x:y].tobytes()
                        if kind == 0 and own_salts[x:y].any():
                            row[1] = own_salts[x:y].astype("<u4").tobytes()
                parts = [pa.array(x, pa.binary()) for x in zip(*rows.values())] if rows else [pa.array([], pa.binary())] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *parts], names=["bucket", "postings", "salts", "sets"])

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, CHUNK)


def shared_postings(chunks: DataFrame) -> DataFrame:
    """Postings of shingles that two classes or more have, and, without a shingle, every class with its n and l.

    A bucket is put together and sorted at once. A salted shingle is kept even if its run has one class, since
    other runs may have more; only shingles in a cell that stands out are salted, so that hardly any of these is alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for b in batches:
            for bucket, *row in zip(b.column("bucket").to_pylist(), *(b.column(c) for c in ("postings", "salts", "sets"))):
                if bucket != now and held:
                    yield from _bucket_rows(held)
                    held = []
                now = bucket
                held.append([x.as_buffer().to_pybytes() for x in row])
        if held:
            yield from _bucket_rows(held)

    return scratch.cut(chunks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SHARED), "postings")


def _bucket_rows(held: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    listed = np.frombuffer(b"".join(x[2] for x in held), _SET)
    names = ["shingle", "salt", "set_id", "n", "matches"]
    if len(listed):
        listed = np.unique(listed)
        n = len(listed)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *(pa.array(listed[c]) for c in ("set_id", "n", "matches"))], names=names)
    pairs = np.frombuffer(b"".join(x[0] for x in held), "<i8").reshape(-1, 2)
    salt = np.concatenate([np.frombuffer(x[1], "<u4").astype(np.int32) if x[1] else np.zeros(len(x[0]) // 16, np.int32) for x in held])
    order = np.lexsort((pairs[:, 1], pairs[:, 0], salt))
    s, ids, salt = pairs[order, 0], pairs[order, 1], salt[order]
    start = np.ones(len(s), bool)
    start[1:] = (s[1:] != s[:-1]) | (salt[1:] != salt[:-1])
    new = start.copy()
    new[1:] |= ids[1:] != ids[:-1]
    s, ids, salt, start = s[new], ids[new], salt[new], start[new]
    at = np.flatnonzero(start)
    keep = np.repeat(np.diff(np.append(at, len(s))) > 1, np.diff(np.append(at, len(s)))) | (salt > 0)
    n = int(keep.sum())
    yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(salt[keep]), pa.array(ids[keep]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names=names)


def _alike(a: str, b: str, p: Params) -> str:
    """SQL: could sets of these sizes link?"""
    return f"100L * least({a}, {b}) >= {p.percent}L * greatest({a}, {b})"


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def weighed_postings(shared: DataFrame, p: Params) -> DataFrame:
    """Postings that can be part of a candidate pair, with ``weight``, the share of its prefix that a class has in common.

    A class and a partner share as many of their prefixes as the smaller l asks for, and no partner is
    smaller than ``percent`` of it: a class with fewer shared postings than that has no partner.
    """
    common = shared.groupBy("set_id").agg(F.count("shingle").alias("c"), F.max("n").alias("n"), F.max("matches").alias("matches"))
    whole = f"(n - (({p.percent} * n + 99) div 100) + matches)"
    asked = f"least(matches, {_least_matches(f'(({p.percent} * n + 99) div 100)', p)})"
    central = common.withColumn("asked", F.expr(f"cast({asked} as int)")).where("c >= asked").select("set_id", "n", "asked", F.expr(f"cast(1000 * c / {whole} as int)").alias("weight"))
    return scratch.cut(shared.where("shingle IS NOT NULL").select("shingle", "salt", "set_id").join(central, "set_id"), "weighed")


def _differing_bits(a: str, b: str) -> str:
    """SQL: the bits in which two signatures differ, the longer one folded to the length of the other."""
    words = f"least(size({a}), size({b}))"
    fold = lambda x: f"aggregate(sequence(0, size({x}) div {words} - 1), 0L, (s, j) -> s ^ {x}[i + j * {words}])"
    return f"aggregate(transform(sequence(0, {words} - 1), i -> bit_count({fold(a)} ^ {fold(b)})), 0, (s, c) -> s + c)"


def _near(p: Params) -> str:
    """SQL: do the signatures x and y tell, by estimate, a similarity of about one half or more?

    Of d shingles that only one set has, about ``bits / 2 * (1 - exp(-2 d / bits))`` bits differ.
    """
    bits = "(64.0D * least(size(x_parity), size(y_parity)))"
    return f"{_differing_bits('x_parity', 'y_parity')} <= {bits} / 2 * (1 - exp(-2 * (x_n + y_n) / 3 / {bits}))"


def similar(pairs: DataFrame, classes: DataFrame, p: Params, a: str = "a", b: str = "b", near: bool = False) -> DataFrame:
    """The pairs of class ids whose signatures don't rule out a link; or those that are near by estimate."""
    for s, c in (("x", a), ("y", b)):
        pairs = pairs.join(classes.select(F.col("set_id").alias(c), F.col("n").alias(f"{s}_n"), F.col("parity").alias(f"{s}_parity")), c)
    possible = f"{_differing_bits('x_parity', 'y_parity')} <= x_n + y_n - 2 * {_least_shared('x_n', 'y_n', p)}"
    return pairs.where(f"{_alike('x_n', 'y_n', p)} AND {_near(p) if near else possible}").select(a, b)


def hub_pairs(weighed: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """(set_id, hub): every class with the hub that it meets most often, if the two are near.

    The hub of a run is the class that has most of its prefix in common with others: in a group of
    near copies that is the text that the others were made from, or the one nearest to it. Hubs that are met
    in few runs are left out: such a class is a family of its own, which costs, but loses, nothing.
    """
    own = F.struct("weight", F.col("set_id").alias("hub"), F.col("n").alias("m"))
    top = F.max(own).over(Window.partitionBy("shingle", "salt"))
    hubbed = weighed.select("shingle", "salt", "set_id", "n", "asked", top.alias("w")).select("shingle", "salt", "set_id", "n", "asked", "w.*")
    met = hubbed.where(f"set_id <> hub AND {_alike('n', 'm', p)}").groupBy("set_id", "hub").agg(F.count("*").alias("c"), F.max("weight").alias("weight"), F.first("asked").alias("asked"))
    best = met.where("8 * c >= asked").groupBy("set_id").agg(F.max(F.struct("c", "weight", "hub")).alias("x")).select("set_id", "x.hub")
    # the hubs of a salted shingle's runs meet each other
    hubs = hubbed.where("salt > 0").select("shingle", "hub", "m", "weight").distinct()
    tops = hubs.groupBy("shingle").agg(F.max(F.struct("weight", F.col("hub").alias("h"), F.col("m").alias("k"))).alias("t"))
    joined = hubs.join(tops, "shingle").where(f"hub <> t.h AND {_alike('m', 't.k', p)}").select(F.col("hub").alias("set_id"), F.col("t.h").alias("hub"))
    return scratch.cut(similar(best.unionAll(joined).distinct(), classes, p, "set_id", "hub", near=True), "hubs")


def roots(hubs: DataFrame, jumps: int = 4) -> DataFrame:
    """(set_id, hub) with the hub's hub and so on, a power of two of steps up: hubs are ever more central."""
    up = hubs.groupBy("set_id").agg(F.max("hub").alias("hub"))
    for _ in range(jumps):
        above = up.select(F.col("set_id").alias("hub"), F.col("hub").alias("next"))
        up = scratch.cut(up.join(above, "hub", "left").select("set_id", F.coalesce("next", "hub").alias("hub")), "roots")
    return up


def _bloom(ids: DataFrame, p: Params) -> tuple[Broadcast, list[Column]]:
    """A filter with two hashes of each doc_id, 16 bits for an id up to the largest size, and the columns that ask it."""
    bits = min(p.bloom_bits, max(64, 1 << (16 * ids.count()).bit_length()))
    where = [F.pmod(F.xxhash64("doc_id", F.lit(s)), F.lit(bits)).alias(f"at{s}") for s in (1, 2)]
    at = ids.select(F.explode(F.array(*where)).alias("at"))
    words = at.groupBy(F.expr("cast(at div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out), where


def _hits(b: pa.RecordBatch, bits: np.ndarray) -> np.ndarray:
    ok = np.ones(b.num_rows, bool)
    for c in ("at1", "at2"):
        at = b.column(c).to_numpy()
        ok &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return ok


def texts_of(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """``wanted`` (doc_id, set_id and more) with each one's text."""
    wanted = scratch.cut(wanted, "wanted")
    sent, where = _bloom(wanted, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            b = b.filter(pa.array(_hits(b, sent.value)))
            for first, last, buf, offs in tk.blocks(b.column("text")):
                ids = shingle_sets(buf, offs, p.k).ids()
                out = pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array(ids), b.column("text").slice(first, last - first)], names=["doc_id", "set_id", "text"])
                fresh = [x not in seen and not seen.add(x) for x in zip(out["doc_id"].to_pylist(), ids.tolist())]
                yield out.filter(pa.array(fresh, pa.bool_()))

    # the set's hash is taken from the text: rows that share an id may have different sets
    read = docs.where("doc_id IS NOT NULL").select("doc_id", "text", *where).mapInArrow(run, "doc_id long, set_id long, text string")
    once = read.groupBy("doc_id", "set_id").agg(F.first("text").alias("text"))  # rows may repeat
    out = scratch.cut(once.join(wanted.hint("merge"), ["doc_id", "set_id"]).drop("doc_id"), "texts")
    sent.unpersist()
    scratch.drop(wanted)
    return out


HUBBED = "set_id long, hub long, n int, overlap int, linked boolean, whole boolean, rest array<long>"


def to_hubs(hubs: DataFrame, docs: DataFrame, classes: DataFrame, sent: Broadcast, p: Params) -> DataFrame:
    """Every class measured against its hubs (set_id, hub), from their whole texts.

    ``overlap`` counts the shingles that both have; ``rest`` are the class's others, all of them
    (``whole``), or the rarest ones if any partner must share so many of them that these are enough.
    """
    sides = hubs.unionByName(hubs.select(F.col("hub").alias("set_id"), "hub")).distinct()
    texts = texts_of(docs, sides.join(classes.select("set_id", F.col("first_id").alias("doc_id")), "set_id"), p)
    x = texts.where("set_id <> hub").select("hub", "set_id", F.col("text").alias("text_a"))
    y = texts.where("set_id = hub").select("hub", F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, out = {}, []
            for i in range(b.num_rows):
                hub = b.column("hub")[i].as_py()
                if hub not in known:
                    if len(known) > 64:
                        known.clear()
                    known[hub] = _set_of(b.column("text_b")[i], p)
                s, t = _set_of(b.column("text_a")[i], p), known[hub]
                inside = np.isin(s, t, assume_unique=True)
                same, rest = int(inside.sum()), s[~inside]
                # a partner has ceil(percent * n) of the shingles, of which the hub's own are at most these
                spare = -(-p.percent * len(s) // 100) - same
                if spare > 1:
                    often = sent.value[_cells(rest, p.sketch_width)]
                    rest = rest[np.lexsort((rest, often))][: max(0, len(rest) - spare + 1)]
                out.append((hub, len(s), same, 100 * same >= p.percent * (len(s) + len(t) - same), spare <= 1, rest.view(np.int64)))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("set_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[c.split()[0] for c in HUBBED.split(", ")])

    joined = x.join(y, "hub").select("set_id", "hub", "text_a", "text_b")
    out = scratch.cut(joined.mapInArrow(run, HUBBED), "to-hubs")
    scratch.drop(texts)
    return out


def _set_of(text: pa.Scalar, p: Params) -> np.ndarray:
    buf = np.frombuffer(text.as_buffer(), np.uint8)
    return shingle_sets(buf, np.array([0, len(buf)]), p.k).values


def families(measured: DataFrame, root: DataFrame) -> DataFrame:
    """(set_id, hub, n, overlap, whole, rest, component): every class with its root; a root is its own.

    ``component`` is a class that it is known to be connected with: the root if it links with it, or
    else what a hub that it links with is known to be connected with, or else itself.
    """
    hubs = root.select(F.col("hub").alias("set_id")).distinct().withColumn("is_hub", F.lit(True))
    marked = measured.join(root, ["set_id", "hub"], "left_semi").join(hubs, "set_id", "left").withColumn("is_hub", F.expr("is_hub IS NOT NULL"))
    own = lambda c, v: F.when(F.col("is_hub"), v).otherwise(F.col(c)).alias(c)
    one = marked.select("set_id", "is_hub", own("hub", F.col("set_id")), "n", own("overlap", F.col("n")), own("whole", F.lit(True)), own("rest", F.expr("cast(array() as array<bigint>)")), F.expr("CASE WHEN linked AND NOT is_hub THEN hub ELSE set_id END").alias("component"))
    one = scratch.cut(one, "families")
    via = measured.where("linked").groupBy("set_id").agg(F.min("hub").alias("via"))
    over = via.join(one.select(F.col("set_id").alias("via"), F.col("component").alias("over")), "via", "left").select("set_id", F.coalesce("over", "via").alias("over"))
    known = F.expr("CASE WHEN is_hub OR component <> set_id THEN component ELSE coalesce(over, set_id) END")
    two = scratch.cut(one.join(over, "set_id", "left").withColumn("component", known).drop("is_hub", "over"), "families")
    scratch.drop(one)
    return two


def _least_shared(n: str, m: str, p: Params) -> str:
    """SQL: shingles that sets of these sizes must share to link."""
    return f"(({p.percent}L * ({n} + {m}) + {99 + p.percent}L) div {100 + p.percent}L)"


#: Parts of a family's classes that may link by their overlaps alone.
PARTS = 16


def family_pairs(family: DataFrame, p: Params) -> DataFrame:
    """(a, b): all candidates among the classes of one root that aren't known to be connected.

    Two classes share at most the smaller of their overlaps with the root, and what they share
    besides. If the first is too little for a link, they must have a shingle in common that the root
    lacks, and if all of these are listed, as many as are wanting. If the first might be enough, which
    takes texts shorter than the root's, the pair is taken as it is. One of the two, a, is not connected with
    the root, else both are in its component.
    """
    sides = {}
    for s in "ab":
        sides[s] = family.select("hub", *(F.col(c).alias(f"{s}_{c}") for c in ("set_id", "n", "overlap", "whole", "component")), F.col("rest").alias(f"{s}_rest"))
    sides["a"] = sides["a"].where("a_component <> hub")
    differ = f"(b_component = hub OR a_set_id < b_set_id) AND a_component <> b_component AND {_alike('a_n', 'b_n', p)}"
    wanting = f"({_least_shared('a_n', 'b_n', p)} - least(a_overlap, b_overlap))"
    listed = {s: sides[s].select("*", F.explode(f"{s}_rest").alias("shingle")).drop(f"{s}_rest") for s in "ab"}
    met = listed["a"].join(listed["b"], ["hub", "shingle"]).where(f"{differ} AND {wanting} > 0")
    counted = met.groupBy("a_set_id", "b_set_id").agg(F.count("*").alias("c"), F.first(F.expr(f"CASE WHEN a_whole AND b_whole THEN {wanting} ELSE 1 END")).alias("need")).where("c >= need")
    # overlaps that may be enough: only of classes that are smaller, together, than their overlap allows
    loose = family.groupBy("hub").agg(F.min("n").alias("smallest"))
    may = {s: sides[s].drop(f"{s}_rest").join(loose, "hub").where(f"{_least_shared(f'{s}_n', 'smallest', p)} <= {s}_overlap").drop("smallest") for s in "ab"}
    every = may["a"].withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    near = every.join(may["b"].withColumn("part", F.expr(f"cast(pmod(b_set_id, {PARTS}) as int)")), ["hub", "part"]).where(f"{differ} AND {wanting} <= 0")
    return counted.select(*_pair("a_set_id", "b_set_id")).unionAll(near.select(*_pair("a_set_id", "b_set_id")))


def cross_pairs(weighed: DataFrame, family: DataFrame, p: Params) -> DataFrame:
    """(a, b): all candidates of different roots that aren't known to be connected.

    Shingles of one family, or of classes known to be connected, have no such pair. Of its other shared postings a
    class and a partner have ``asked`` in common, at least. So the first of those that they have in common, from the shortest run to the
    longest, is among all but the last ``asked - 1`` postings of either; only those are joined. Classes with fewer than ``asked`` have no partner.
    """
    rows = weighed.select("shingle", "set_id", "n", "asked").join(family.select("set_id", "hub", "component"), "set_id", "left")
    rows = scratch.cut(rows.withColumns({"hub": F.coalesce("hub", "set_id"), "component": F.coalesce("component", "set_id")}), "cross")
    runs = rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("hub").alias("u"), F.max("hub").alias("v"), F.count("*").alias("run"))
    left = rows.join(runs.where("x <> y AND u <> v").select("shingle", "run"), "shingle")
    own = Window.partitionBy("set_id")
    ranked = left.withColumn("place", F.row_number().over(own.orderBy("run", "shingle"))).withColumn("all", F.count("*").over(own))
    seeds = scratch.cut(ranked.where("place <= all - asked + 1").drop("run", "place", "all", "asked"), "seeds")
    scratch.drop(rows)
    x, y = (seeds.select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in ("set_id", "n", "component", "hub"))) for s in "ab")
    met = x.join(y, "shingle").where(f"a_set_id < b_set_id AND a_component <> b_component AND a_hub <> b_hub AND {_alike('a_n', 'b_n', p)}")
    return met.select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"))


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of class ids that really link, from their whole texts."""
    sides = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select(F.col("b").alias("set_id"))).distinct()
    texts = texts_of(docs, sides.join(classes.select("set_id", F.col("first_id").alias("doc_id")), "set_id"), p)
    x, y = (texts.select(F.col("set_id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[int, np.ndarray] = {}
            out = []
            for i in range(b.num_rows):
                sides = []
                for c in ("a", "b"):
                    key = b.column(c)[i].as_py()
                    if key not in known:
                        if len(known) > 64:
                            known.clear()
                        known[key] = _set_of(b.column(f"text_{c}")[i], p)
                    sides.append(known[key])
                s, t = sides
                same = len(np.intersect1d(s, t, assume_unique=True))
                out.append(100 * same >= p.percent * (len(s) + len(t) - same))
            yield b.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
    out = scratch.cut(joined.mapInArrow(run, "a long, b long"), "linked")
    scratch.drop(texts)
    return out


def labelled(classes: DataFrame, family: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, component_id, top): the smallest first_id of all classes that links (a, b) and known components connect, and one of these classes."""
    name = family.where("component <> set_id").select("set_id", "component")
    hops = links.join(name.withColumnsRenamed({"set_id": "a", "component": "x"}), "a", "left").join(name.withColumnsRenamed({"set_id": "b", "component": "y"}), "b", "left")
    tops = components(hops.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    named = classes.select("set_id", "first_id").join(name, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = named.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    named = scratch.cut(named.select("set_id", "first_id", F.coalesce("top", "component").alias("top")), "named")
    least = named.groupBy("top").agg(F.min("first_id").alias("component_id"))
    return scratch.cut(named.join(least, "top").select("set_id", "component_id", "top"), "by-set")


def cluster(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, top) of every row of ``docs`` (doc_id, text); ``top`` tells components apart, also those of one id."""
    surveyed = survey(docs, p)
    rows = surveyed.where("block IS NULL").select("doc_id", "set_id", "n")
    linking = surveyed.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.cut(linking.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.first("n").cast("int").alias("n"), F.first("parity").alias("parity")), "classes")
    sent = docs.sparkSession.sparkContext.broadcast(read_sketch(surveyed, p))
    expected = (classes.agg(F.sum("n")).first()[0] or 0) * (100 - p.percent) * 5 // 400
    shared = shared_postings(postings(docs, sent, 16 + expected // BUCKET, p))
    weighed = weighed_postings(shared, p)
    scratch.drop(shared)
    hubs = hub_pairs(weighed, classes, p)
    root = roots(hubs)
    measured = to_hubs(hubs.unionByName(root).distinct(), docs, classes, sent, p)
    sent.unpersist()
    family = families(measured, root)
    pairs = family_pairs(family, p).unionAll(cross_pairs(weighed, family, p)).distinct()
    pairs = scratch.cut(similar(pairs, classes, p), "pairs")
    links = measured.where("linked").select(F.col("set_id").alias("a"), F.col("hub").alias("b")).unionAll(linked(pairs, docs, classes, p))
    by_set = labelled(classes, family, links)
    scratch.drop(weighed, measured, family, pairs)
    out = rows.join(by_set, "set_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "set_id", "top")


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns.

    Of several rows with that id in the component one stays, the first by its text; texts of one id that don't link are
    components of their own, and each stays. Rows with a
    null id stay, and so do those without a word. Only rows that a Bloom filter of the ids in question lets
    through are joined with their fate; all others pass without a shuffle.
    """
    found = cluster(docs, p).where("doc_id IS NOT NULL AND n_shingles > 0")
    fate = found.groupBy("doc_id", "set_id", "component_id", "top").agg(F.count("*").alias("c"))
    twins = fate.where("doc_id = component_id").groupBy("doc_id", "top").agg(F.sum("c").alias("c")).where("c > 1").select("doc_id", "top", F.lit(True).alias("twin"))
    fate = scratch.cut(fate.join(twins, ["doc_id", "top"], "left").where("doc_id <> component_id OR twin").select("doc_id", "set_id", "top", "twin"), "fate")
    sent, where = _bloom(fate, p)
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", *where)
    row = packed.schema["row"]

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["row"]).filter(pa.array(~_hits(b, sent.value)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(_hits(b, sent.value)))
            for first, last, buf, offs in tk.blocks(b.column("text")):
                yield b.select(["row", "doc_id"]).slice(first, last - first).append_column("set_id", pa.array(shingle_sets(buf, offs, p.k).ids()))

    passed = packed.select("row", "at1", "at2").mapInArrow(free, T.StructType([row]))
    joined = packed.mapInArrow(asked, T.StructType([row, T.StructField("doc_id", T.LongType()), T.StructField("set_id", T.LongType())]))
    joined = joined.join(fate.withColumn("known", F.lit(True)).hint("merge"), ["doc_id", "set_id"], "left")
    order = Window.partitionBy("doc_id", "top").orderBy("row.text", "set_id")
    several = joined.where("twin").withColumn("at", F.row_number().over(order)).where("at = 1")
    out = passed.unionAll(joined.where("known IS NULL").select("row"))
    if not fate.where("twin").isEmpty():  # ids usually are unique
        out = out.unionAll(several.select("row"))
    return out.select("row.*")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")

