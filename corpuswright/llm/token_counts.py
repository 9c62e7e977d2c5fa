"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A pre-token is a word mark followed by a run of characters between white space. Its best
segmentation maximises the sum of the piece scores; a character that no piece covers is taken alone at
``unknown`` and counts as its UTF-8 bytes. Of equal sums the segmentation whose last piece is the
shortest wins, at every prefix.

The forward scores of a pre-token depend on its prefixes only, so pre-tokens that share a prefix share
its scores. The distinct pre-tokens of a block of texts are put in order, which is a depth-first walk of
their trie: going from one to the next, the scores of the common prefix stay and only the characters
after it are computed. Each pre-token's end stores its token count, and texts sum up the counts of
their words. Blocks are bounded, so the trie is; counts are kept in a bounded cache between blocks.

Defined results: a null or empty text has no pre-token and no token; null ids stay null; repeated rows
have equal counts; an empty table gives an empty table. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as tk

MARK = "▁"
RESULT = "doc_id long, n_pretokens long, n_tokens long"


class Unigram:
    """Pieces and scores; ``count`` gives the tokens of words in sorted order."""

    def __init__(self, pieces: dict[str, float], cache_words: int = 500_000) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.cache: dict[bytes, int] = {}
        self.cache_words = cache_words
        self.steps = 0

    def count(self, words: list[str]) -> list[int]:
        """Tokens of each of the words, which must be sorted."""
        pieces, longest = self.pieces, self.longest
        best, tokens = [0.0], [0]
        out, before = [], ""
        for word in words:
            keep, most = 0, min(len(word), len(before))
            while keep < most and word[keep] == before[keep]:
                keep += 1
            del best[keep + 1 :], tokens[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                top, n = best[end - 1] + self.unknown, tokens[end - 1] + len(word[end - 1].encode())
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    score = pieces.get(word[start:end])
                    if score is not None and best[start] + score > top:
                        top, n = best[start] + score, tokens[start] + 1
                best.append(top)
                tokens.append(n)
            self.steps += len(word) - keep
            out.append(tokens[-1])
            before = word
        return out

    def totals(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of a block's texts."""
        starts, ends, ptr = tk.split(buf, offs, tk.SPACES)
        n = np.diff(ptr)
        if not len(starts):
            return n, np.zeros(len(n), np.int64)
        codes, first = tk.distinct(buf, starts, ends)
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        raw = buf.tobytes()
        known = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        new = sorted((MARK + w.decode(), w) for w in known if w not in self.cache)
        self.cache.update(zip((w for _, w in new), self.count([w for w, _ in new])))
        counts = np.fromiter(map(self.cache.__getitem__, known), np.int64, len(known))[codes]
        total = np.append(0, np.cumsum(counts))
        return n, total[ptr[1:]] - total[ptr[:-1]]


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """The ordinary pieces of a sentencepiece model, with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)))
    return Unigram({model.id_to_piece(i): model.get_score(i) for i in ordinary})


def count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every whole text of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            for first, last, buf, offs in tk.blocks(b.column("text")):
                n, tokens = model.totals(buf, offs)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array(n.astype(np.int64)), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
