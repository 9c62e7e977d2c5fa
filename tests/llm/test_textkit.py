import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from corpuswright.llm import textkit as tk

from .twins import PAIRS

ALPHABET = [" ", "  ", "\n", "\t", " ", "　", "'", "'s", "'re", "'ll", "'ve", "'t", "'", "a", "be", "É", "ß", "1", "²", "!", "?", "日本", "😀", "é", "‍", "'S", "\x1c", "\x85"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 14))) for _ in range(n)]


def test_pretokens_equal_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = random_texts(4000, 1) + ["", None, "x" * 5000, "   ", "\n\n a"]
    for block in (50, 1000, 1 << 20):
        seen = 0
        for first, end, buf, offs in tk.blocks(pa.array(texts), block):
            starts, ptr = tk.pretokens(buf, offs)
            for i in range(end - first):
                cuts = [*starts[ptr[i] : ptr[i + 1]], offs[i + 1]]
                got = [bytes(buf[a:b]).decode() for a, b in zip(cuts, cuts[1:])]
                assert got == pattern.findall(texts[first + i] or ""), repr(texts[first + i])
                seen += 1
        assert seen == len(texts)


def test_words_and_shingles_equal_plain_python():
    texts = random_texts(500, 2) + ["a b c d e f a b c d e f", "a", "a b c d", None, "A  b\tC"]
    plain = {}
    for first, end, buf, offs in tk.blocks(pa.array(texts), 300):
        buf = tk.LOWER[buf]
        s, e, ptr = tk.split(buf, offs, tk.SPACES)
        h = tk.hash_ranges(buf, s, e)
        g, own = tk.shingles(h, ptr, 3)
        for i in range(end - first):
            low = (texts[first + i] or "").encode().translate(bytes(tk.LOWER))
            words = regex.findall(rb"[^\x20\x09-\x0D]+", low)
            assert [bytes(buf[a:b]) for a, b in zip(s[ptr[i] : ptr[i + 1]], e[ptr[i] : ptr[i + 1]])] == words
            want = [tuple(words[j : j + 3]) for j in range(len(words) - 2)] if len(words) >= 3 else [tuple(words)] if words else []
            got = g[own == i]
            assert len(got) == len(want)
            for x, y in zip(want, got.tolist()):
                assert plain.setdefault(x, y) == y
    assert len(set(plain.values())) == len(plain)


def test_blocks_of_a_sliced_array():
    a = pa.array(["ab", None, "cde", ""])[1:]
    (first, end, buf, offs), = tk.blocks(a)
    assert (first, end, bytes(buf), offs.tolist()) == (0, 3, b"cde", [0, 0, 3, 3])
    assert list(tk.blocks(pa.array([], pa.string()))) == []
    assert np.array_equal(tk.hash_ranges(np.frombuffer(b"xxabab", np.uint8), np.array([2, 4]), np.array([4, 6]))[:1], tk.hash_ranges(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])))


def test_ranges_are_told_apart():
    r = random.Random(8)
    parts = [x.encode() for pair in PAIRS for x in pair] + [bytes(r.choices(b"ab", k=r.randrange(40))) for _ in range(3000)] + [b"x" * n for n in range(250, 262)] * 2
    buf = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    starts = ends - [len(x) for x in parts]
    h = tk.hash_ranges(buf, starts, ends).tolist()
    assert len(set(zip(h, parts))) == len(set(h)) == len(set(parts))
    assert [int(tk.hash_ranges(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in parts[:40]] == h[:40]
    codes, first = tk.distinct(buf, starts, ends)
    assert [parts[first[c]] for c in codes] == parts and len(first) == len(set(parts))


def test_equal_hashes_of_different_bytes_change_nothing(monkeypatch):
    monkeypatch.setattr(tk, "hash_ranges", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    parts = [b"one", b"two", b"one", b"", b"t" * 300, b"t" * 299 + b"u", b"t" * 300]
    ends = np.cumsum([len(x) for x in parts])
    starts = ends - [len(x) for x in parts]
    codes, first = tk.distinct(np.frombuffer(b"".join(parts), np.uint8), starts, ends)
    assert [parts[first[c]] for c in codes] == parts and len(first) == 5
