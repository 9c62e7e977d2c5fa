"""Vectorised text kernels on Arrow batches: words, hashes of byte ranges, shingles, pre-tokens.

Everything works on the UTF-8 bytes of a whole block of texts at once. A block is a run of rows
with a bounded number of bytes (always at least one whole text), so that the arrays stay small
whatever the batch size is; no text is ever shortened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
U64 = np.uint64


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) for runs of rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + block_bytes, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: Longer ranges are hashed one by one; the others eight bytes at a time, side by side.
_SIDE_BY_SIDE = 256
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [_MASK], U64)


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as an integer, zeros after the end; a view, not aligned."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal bytes give equal hashes in any block.

    Every eight bytes are mixed with the hash of those before: no sum of bytes and powers, for which whole families of
    texts collide.
    """
    lens = ends - starts
    h, words = mix(lens.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(_BASE & _MASK)), _words_at(buf)
    left = np.flatnonzero((lens > 0) & (lens <= _SIDE_BY_SIDE))
    at = 0
    while len(left):
        rest = lens[left] - at
        block = words[starts[left] + at] & _LOW_BYTES[np.minimum(rest, 8)]
        h[left] = mix((h[left] ^ block) * U64(_BASE & _MASK) + block)
        at += 8
        left = left[rest > 8]
    for i in np.flatnonzero(lens > _SIDE_BY_SIDE).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, key=b"range").digest(), "little")
    return h


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> bool:
    """Are the bytes from each of ``a`` on those from ``b`` on, as many as ``lens`` says?"""
    words, at = _words_at(buf), 0
    short = lens <= _SIDE_BY_SIDE
    x, y, n = a[short], b[short], lens[short]
    while len(x):
        low = _LOW_BYTES[np.minimum(n - at, 8)]
        if ((words[x + at] ^ words[y + at]) & low).any():
            return False
        at += 8
        more = n > at
        x, y, n = x[more], y[more], n[more]
    return all(np.array_equal(buf[i : i + k], buf[j : j + k]) for i, j, k in zip(a[~short].tolist(), b[~short].tolist(), lens[~short].tolist()))


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range the number of its bytes among the distinct ones, and the first range of each of these.

    Hashes only find equal ranges; their bytes are compared, and if any differ, all are told apart by their bytes.
    """
    codes, keys = pd.factorize(hash_ranges(buf, starts, ends))
    first = np.zeros(len(keys), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    lens = ends - starts
    same = first[codes]
    other = np.flatnonzero(same != np.arange(len(codes)))
    if np.array_equal(lens[other], lens[same[other]]) and _equal(buf, starts[other], starts[same[other]], lens[other]):
        return codes, first
    raw, seen = buf.tobytes(), {}
    codes = np.fromiter((seen.setdefault(raw[i:j], len(seen)) for i, j in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
    first = np.zeros(len(seen), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def split(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are no separator, text by text: starts, ends, and where each text's runs begin."""
    inside = ~separator[buf]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[offs[:-1][offs[:-1] < len(buf)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        after[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Space and the control characters 9 to 13.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def owners(ptr: np.ndarray) -> np.ndarray:
    """For pointers into a list, text by text, the text that each entry belongs to."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def shingles(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the text of each; a text of fewer words has one, of all its words."""
    n, owner = len(h), owners(ptr)
    factors = mix(np.arange(1, k + 1, dtype=U64) * U64(_BASE & _MASK)) | U64(1)
    m = max(0, n - k + 1)
    total = np.zeros(m, U64)
    for j in range(k):
        total += h[j : j + m] * factors[j]
    full = owner[:m] == owner[k - 1 :] if m else np.zeros(0, bool)
    out, own = mix(total[full] + U64(k)), owner[:m][full]
    counts = np.diff(ptr)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        total = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = counts[short] > j
            total[has] += h[ptr[short[has]] + j] * factors[j]
        out = np.concatenate([out, mix(total + counts[short].astype(U64))])
        own = np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


# Unicode classes of the pre-token pattern
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            skip = lambda i: i if i < 0xD800 else i + 0x800
            out[skip(a) : skip(b - 1) + 1] = kind
    return out


def classes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the character that each byte is part of, and flags of bytes that begin a character."""
    table = class_table()
    cls = table[:128][np.minimum(buf, 127)]
    begins = (buf & 0xC0) != 0x80
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = buf.astype(np.int32)
        pad = np.concatenate([b, np.zeros(3, np.int32)])
        b0, b1, b2, b3 = pad[lead], pad[lead + 1] & 63, pad[lead + 2] & 63, pad[lead + 3] & 63
        two, three = b0 < 0xE0, (b0 >= 0xE0) & (b0 < 0xF0)
        cp = np.where(two, (b0 & 31) << 6 | b1, np.where(three, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = table[np.minimum(cp, 0x10FFFF)]
        cls[lead] = kind
        for j, has in ((1, np.ones(len(lead), bool)), (2, ~two), (3, ~two & ~three)):
            cls[lead[has] + j] = kind[has]
    return cls, begins


_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def pretokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the matches of the byte-level BPE pattern, text by text, and where each text's matches begin.

    The pattern: contractions, then a letter, number or other run with one optional space before
    it, then white space without its last character if something follows, then white space. Its
    matches cover a text without gaps, so starts are enough.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    cls, begins = classes(buf)
    first = np.zeros(n, bool)
    first[offs[:-1][offs[:-1] < n]] = True
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = cls[1:] != cls[:-1]
    change |= first
    run = np.flatnonzero(change)  # runs of one class within a text
    kind = cls[run]
    end = np.append(run[1:], n)
    follows = np.append(~first[run[1:]], False)  # another run of the same text comes after
    cut = change.copy()
    # white space before something else: its last character stands alone, or joins it if it is a space
    white = np.flatnonzero((kind == SPACE) & follows)
    last = end[white] - 1
    while True:
        inner = ~begins[last]
        if not inner.any():
            break
        last[inner] -= 1
    cut[last] = True
    joins = buf[last] == 0x20
    cut[end[white[joins]]] = False
    # a contraction is an apostrophe with letters after it where a match begins
    quote = np.flatnonzero((buf == 0x27) & cut)
    quote = quote[(quote + 1 < n)]
    quote = quote[(cls[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        nxt = np.concatenate([buf, np.zeros(2, np.uint8)])
        stop_at = offs[np.searchsorted(offs, quote, side="right")]
        a, b = nxt[quote + 1], np.where(quote + 2 < stop_at, nxt[quote + 2], 0)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        for q, size in ((quote[one], 2), (quote[two & ~one], 3)):
            cut[q + 1] = False
            after = q + size
            inside = after < stop_at[np.searchsorted(quote, q)]
            cut[after[inside]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offs)
