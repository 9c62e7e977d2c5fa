"""Byte-level BPE over blocks of texts: vocabularies, an encoder with a word cache, the byte table.

Pre-tokens are independent of each other under BPE, so each distinct one is encoded once and its
ids are copied to wherever it stands. Pre-tokens are told apart by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs

from . import textkit as tk


def read_bytes(path: str) -> bytes:
    """A vocabulary file: a plain path, or a URI of a file system that pyarrow knows."""
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(inner) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, where ids are merge ranks.

    A ``.json`` file of the tokenizers library qualifies if its model is a byte-level BPE whose
    merges make the ids in ascending order; anything else raises.
    """
    data = read_bytes(path)
    if not path.endswith(".json"):
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    spec = json.loads(data)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if spec.get("normalizer") or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE file")
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
        raise ValueError("the BPE model has options beyond byte-level merges")
    special = {t["id"] for t in spec.get("added_tokens", [])}
    chars = _byte_characters()
    ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
    last = -1
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        at = model["vocab"][a + b]
        if at <= last:
            raise ValueError("merges don't make ids in ascending order")
        last = at
    return ranks


def load_added(path: str) -> dict[bytes, int]:
    """Bytes of the added tokens of a ``.json`` file to id; another file has none."""
    if not path.endswith(".json"):
        return {}
    added = [t for t in json.loads(read_bytes(path)).get("added_tokens", []) if t["content"]]
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token has options beyond its text")
    return {t["content"].encode(): t["id"] for t in added}


def byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens in id order, concatenated, and where each begins (one entry more)."""
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, i in ranks.items():
        tokens[i] = token
    offs = np.zeros(size + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=offs[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), offs


def gather(offs: np.ndarray, lens: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The pool's ranges [offs, offs + lens), one after the other."""
    total = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=total[1:])
    return pool[np.repeat(offs - total[:-1], lens) + np.arange(total[-1])]


class Encoder:
    """Ids of texts. ``cache_words`` bounds the memory of the word cache, never the result."""

    def __init__(self, path: str, cache_words: int = 400_000) -> None:
        import tiktoken

        self.ranks = load_ranks(path)
        self.added = load_added(path)
        # where two begin at one place, the longer one
        self.added_pattern = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # the pattern plays no part: only whole pre-tokens are encoded
        self.piece = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.offs = np.zeros(1 << 15, np.int64)
        self.lens = np.zeros(1 << 15, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        encoded = [self.piece(w) for w in words]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), np.uint32, int(sizes.sum()))
        n, end = len(self.index), self.used + len(flat)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end, len(self.pool)), np.uint32)])
        while n + len(words) > len(self.offs):
            self.offs, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offs, self.lens))
        self.pool[self.used : end] = flat
        self.offs[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.lens[n : n + len(words)] = sizes
        self.index.update(zip(words, range(n, n + len(words))))
        self.used = end

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's texts, one text after the other, and where each text's ids begin."""
        starts, ptr = tk.pretokens(buf, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(buf))
        codes, first = tk.distinct(buf, starts, ends)
        if len(self.index) > self.cache_words:
            self._reset()
        raw = buf.tobytes()
        words = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        new = [w for w in words if w not in self.index]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[codes]
        lens = self.lens[at]
        total = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=total[1:])
        return gather(self.offs[at], lens, self.pool), total[ptr]

    def encode_with_added(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, but an added token's literal text is that token; what stands between is encoded by itself."""
        raw = buf.tobytes() if self.added_pattern else b""
        if not any(t in raw for t in self.added):
            return self.encode(buf, offs)
        found = [m for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()) for m in self.added_pattern.finditer(raw, a, b)]
        starts = np.array([m.start() for m in found], np.int64)
        cuts = np.unique(np.concatenate([offs, starts, np.array([m.end() for m in found], np.int64)]))
        ids, ptr = self.encode(buf, cuts)
        lens, at = np.diff(ptr), np.searchsorted(cuts, starts)
        token = np.zeros(len(lens), bool)
        token[at] = True
        total = np.zeros(len(cuts), np.int64)
        np.cumsum(np.where(token, 1, lens), out=total[1:])
        out = np.zeros(total[-1], np.uint32)
        single = np.zeros(len(out), bool)
        single[total[at]] = True
        out[single] = [self.added[m[0]] for m in found]
        out[~single] = ids[np.repeat(~token, lens)]
        return out, total[np.searchsorted(cuts, offs)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)


@lru_cache(maxsize=2)
def decimal_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """"id," of all ids below ``size``, concatenated, and where each begins."""
    words = [b"%d," % i for i in range(size)]
    offs = np.zeros(size + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offs[1:])
    return np.frombuffer(b"".join(words), np.uint8), offs
