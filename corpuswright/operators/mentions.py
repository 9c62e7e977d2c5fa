"""Names that texts mention, found by an automaton over words in one pass over each text.

The distinct names become an Aho-Corasick automaton whose letters are words: a state for each prefix of a name, and for each state
the one of its longest proper suffix. Its arrays are broadcast; how many words they hold is measured first, and beyond a bound
the names are dealt over several automata, each for one pass. Texts are scanned where they are read; only the hits of a
task, each name once, are shuffled.

With an order of the texts, names that lie across the border of two or more texts are found too. A text's border is its first
and last words, one fewer than the longest name has; only borders are put in order, and the automaton runs on from
text to text. A row for each partition, of as many words, goes to the driver for the borders between partitions.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Words of one automaton, at most; a word takes some hundred bytes in a task's memory. Texts that a task numbers at once.
MOST_WORDS, SLICE = 1 << 18, 512
#: Stands between words that aren't next to one another; no word of a text.
GAP = "\x00"


class Automaton:
    """States of all prefixes of word sequences; ``found`` maps a stream of word numbers to sequences."""

    def __init__(self, names: list[list[str]]) -> None:
        self.words = list(dict.fromkeys(w for name in names for w in name))
        number = {w: i for i, w in enumerate(self.words)}
        self.width = len(self.words)
        self.next: dict[int, int] = {}
        self.ends, children = [-1], [[]]
        for i, name in enumerate(names):
            state = 0
            for w in name:
                key = state * self.width + number[w]
                if key not in self.next:
                    self.next[key] = len(self.ends)
                    children[state].append((number[w], len(self.ends)))
                    self.ends.append(-1)
                    children.append([])
                state = self.next[key]
            self.ends[state] = i
        # breadth first: the longest proper suffix that is a prefix too, and the nearest on its chain where a name ends
        self.fail, self.shorter = [0] * len(self.ends), [0] * len(self.ends)
        waiting = deque(child for _, child in children[0])
        while waiting:
            state = waiting.popleft()
            for w, child in children[state]:
                self.fail[child] = self.step(self.fail[state], w)
                waiting.append(child)
            suffix = self.fail[state]
            self.shorter[state] = suffix if self.ends[suffix] >= 0 else self.shorter[suffix]
        # as they are sent to tasks
        self.words = pa.array(self.words, pa.string())
        self.ends, self.fail, self.shorter = (array("i", x) for x in (self.ends, self.fail, self.shorter))

    def step(self, state: int, word: int) -> int:
        while True:
            to = self.next.get(state * self.width + word)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.fail[state]

    def scan(self, words: Iterable[int], state: int, seen: set[int], found: set[int]) -> int:
        """The state after the words (-1: none of a name's); names that end on the way go into ``found``, states into ``seen``."""
        get, width, fail = self.next.get, self.width, self.fail
        for w in words:
            if w < 0:
                state = 0
                continue
            to = get(state * width + w)
            while to is None and state:
                state = fail[state]
                to = get(state * width + w)
            state = to or 0
            if state and state not in seen:
                at = state
                while at and at not in seen:
                    seen.add(at)
                    if self.ends[at] >= 0:
                        found.add(self.ends[at])
                    at = self.shorter[at]
        return state

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of texts (words between single spaces), and where each text's begin."""
        lists = pc.split_pattern(texts, " ")
        found = pc.fill_null(pc.index_in(lists.flatten(), self.words.cast(lists.type.value_type)), -1)
        return found.to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))


def _packed(words: Column) -> Column:
    return F.trim(tx.plain_words(words))


def _scan_texts(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each folded text by itself; the numbers of the names found in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen, found = sent.value, set(), set()
        for text in (b.column("text").slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            # a space at an end makes an empty word, which no name has
            ids, starts = automaton.numbers(pc.replace_substring_regex(text, "[^a-z0-9]+", " "))
            # of words that no name has, one stands for all in a row; so does the border of two texts
            known = ids >= 0
            keep = known.copy()
            keep[1:] |= known[:-1]
            first = starts[:-1][starts[:-1] < len(ids)]
            cut = np.zeros(len(ids), bool)
            cut[first] = True
            at = np.flatnonzero(keep | cut)
            stream = np.insert(ids[at], np.flatnonzero(cut[at] & known[at]), -1)
            automaton.scan(stream.tolist(), 0, seen, found)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["name"])

    return run


def _scan_borders(sent: Broadcast, reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Borders in order, the state running on; the names found, and the partition's own first and last words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen, found, state = sent.value, set(), set(), 0
        head, tail, whole, some = [], [], True, False
        for b in batches:
            ids, _ = automaton.numbers(b.column("text"))
            state = automaton.scan(ids.tolist(), state, seen, found)
            for text in b.column("text").to_pylist():
                words = text.split(" ")
                some = True
                if len(head) < reach:
                    head += words[: reach - len(head)]
                whole = whole and len(tail) + len(words) <= reach
                tail = (tail + words)[-reach:]
        part = TaskContext.get().partitionId()
        names = sorted(found)
        rows = [(part, n, None) for n in names]
        if some:
            rows.append((part, None, " ".join(tail if whole else [*head, GAP, *tail])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["part", "name", "border"])

    return run


def _across(automaton: Automaton, sent: Broadcast, texts: DataFrame, order: tuple[str, ...], reach: int) -> DataFrame:
    """Numbers of the names that lie across borders of texts (*order, text) of words between single spaces."""
    w = F.split("text", " ")
    ends = F.when(F.size(w) <= 2 * reach, F.col("text")).otherwise(F.concat_ws(" ", F.slice(w, 1, reach), F.lit(GAP), F.slice(w, -reach, reach)))
    borders = texts.where("text <> ''").select(*order, ends.alias("text"))
    placed = borders.repartitionByRange(*order).sortWithinPartitions(*order).select("text")
    spark = texts.sparkSession
    rows = placed.mapInArrow(_scan_borders(sent, reach), "part int, name long, border string").collect()
    found = {r["name"] for r in rows if r["name"] is not None}
    between = sorted((r["part"], r["border"]) for r in rows if r["border"] is not None)
    if between:
        ids, _ = automaton.numbers(pa.array([x for _, x in between]))
        automaton.scan(ids.tolist(), 0, set(), found)
    return spark.createDataFrame([(n,) for n in sorted(found)], "name long")


def mentioned(needles: DataFrame, texts: DataFrame, shortest: int = 4, order: tuple[str, ...] = (), most_words: int = MOST_WORDS) -> DataFrame:
    """Needles (id, name) whose words occur one after the other in some text (text), or across texts that follow one another in
    ``order``, columns of ``texts``.

    A name of fewer characters than ``shortest``, spaces between its words included, is nowhere; null texts have no word.
    """
    spark = needles.sparkSession
    wanted = needles.select("id", F.explode(F.array(_packed(F.col("name")))).alias("run")).where(F.length("run") >= shortest)
    size = F.size(F.split("run", " "))
    runs = wanted.select("run").distinct()
    total, longest = runs.agg(F.sum(size), F.max(size)).first()
    folded = texts.select(tx.fold(F.coalesce("text", F.lit(""))).alias("text"))
    worded = texts.select(*order, F.explode(F.array(_packed(F.coalesce("text", F.lit(""))))).alias("text"))
    found, groups = None, max(1, -(-(total or 0) // most_words))
    for g in range(groups if total else 0):
        names = [r["run"] for r in runs.where(F.pmod(F.xxhash64("run"), F.lit(groups)) == g).collect()]  # its words are bounded
        automaton = Automaton([x.split(" ") for x in names])
        sent = spark.sparkContext.broadcast(automaton)
        hits = folded.mapInArrow(_scan_texts(sent), "name long")
        if order and longest > 1:
            hits = hits.unionByName(_across(automaton, sent, worded, order, longest - 1))
        listed = spark.createDataFrame(list(enumerate(names)), "name long, run string")
        met = listed.join(hits.distinct(), "name", "left_semi").select("run")
        found = met if found is None else found.unionByName(met)
    return wanted.limit(0).select("id") if found is None else wanted.join(found, "run", "left_semi").select("id")
