"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Consecutive words of an item that mark a text as contaminated; items with fewer words must occur as a whole or by a line.
WINDOW = 13
#: Lines of items (question, answer) with fewer words are too common to be looked for by themselves.
MIN_WORDS = 8
#: Whole items with fewer words, that is single words, are too common to be looked for.
MIN_ITEM_WORDS = 2
#: Characters of items in one automaton at most, about as many nodes (of some 50 bytes in each Python worker). More items
#: make several automata, each of which scans the texts.
AUTOMATON_CHARS = 8_000_000

_WORD = re.compile(r"\w+")
SCHEMA = "doc_id bigint, item_id bigint, span_start int, span_end int, n_words int"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def normalised(text: str | None) -> list[str]:
    """The words of a text in lower case (by word, as a letter's lower case may hold more than letters)."""
    return " ".join(words(text)).lower().split(" ") if text else []


class Benchmark:
    """An Aho-Corasick automaton over normalised test items, and the items' words.

    Items are cut into blocks of half a window, side by side, so any `window` words in a row hold a whole block. The
    automaton finds blocks; where one is found, item and text are compared to its left and right, which gives the whole
    run of words that they share. So its size is that of the items and not `window` times that. Items shorter than a
    window are patterns as a whole, and so are lines of at least `min_words` words that are shorter than a window.

    Null and empty items, items of a single word and shorter lines give no pattern.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, min_words: int = MIN_WORDS):
        import ahocorasick

        self.window, self.items = window, []
        block = (window + 1) // 2
        found: dict[str, list[tuple[int, int]]] = {}  # owners: number of the item and, for blocks, the block's first word
        sizes: dict[str, int] = {}

        def add(w: list[str], owner: tuple[int, int]) -> None:
            p = f" {' '.join(w)} "
            sizes[p] = len(w)
            found.setdefault(p, []).append(owner)

        for k, (item, text) in enumerate(items):
            whole = normalised(text)
            self.items.append((item, whole))
            if MIN_ITEM_WORDS <= len(whole) < window:
                add(whole, (k, -1))
            elif len(whole) >= window:
                for i in range(0, len(whole) - block + 1, block):
                    add(whole[i : i + block], (k, i))
            lines = {tuple(x) for x in map(normalised, (text or "").split("\n")) if min(min_words, window) <= len(x) < window and len(x) < len(whole)}
            for x in sorted(lines):
                add(list(x), (k, -1))
        self.automaton = ahocorasick.Automaton()
        for p, owners in found.items():
            self.automaton.add_word(p, (sizes[p], owners))
        self.nodes = self.automaton.get_stats()["nodes_count"] if found else 0
        if found:
            self.automaton.make_automaton()
        self.found = found

    def hits(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item's number, first, last + 1) of the runs of words of a text that one of the patterns or windows marks."""
        if not self.found:
            return
        starts, seen = None, {}  # of each item and shift against the text: where the last run that was compared ends
        for end, (n, owners) in self.automaton.iter(f" {' '.join(tokens)} "):
            if starts is None:
                starts = np.fromiter(accumulate((len(t) + 1 for t in tokens), initial=1), np.int64)
            first = int(np.searchsorted(starts, end + 1)) - n
            for k, at in owners:
                if at < 0:
                    yield k, first, first + n
                    continue
                if seen.get((k, first - at), -1) >= first + n:
                    continue
                item = self.items[k][1]
                a, b = first, first + n
                while a and at and tokens[a - 1] == item[at - 1]:
                    a, at = a - 1, at - 1
                at += b - a
                while b < len(tokens) and at < len(item) and tokens[b] == item[at]:
                    b, at = b + 1, at + 1
                seen[k, b - at] = b
                if b - a >= self.window:
                    yield k, a, b

    def marks(self, text: str | None) -> bool:
        return bool(text) and next(self.hits(normalised(text)), None) is not None

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, words) of the matched spans of a text, as offsets in the original text.

        Overlapping and adjacent matches of one item are one span. Order: by item, then by start.
        """
        if not text:
            return []
        spans = sorted({(self.items[k][0], a, b) for k, a, b in self.hits(normalised(text))})
        if not spans:
            return []
        tokens = list(_WORD.finditer(text))
        out: list[list[int]] = []
        for item, first, last in spans:
            if out and out[-1][0] == item and first <= out[-1][2]:
                out[-1][2] = max(out[-1][2], last)
            else:
                out.append([item, first, last])
        return [(item, tokens[first].start(), tokens[last - 1].end(), last - first) for item, first, last in out]


def _groups(bench: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of at most about AUTOMATON_CHARS characters, one group at a time on the driver. What is in a
    group doesn't depend on the order of rows."""
    items = bench.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    groups = max(1, -(-chars // AUTOMATON_CHARS))
    for g in range(groups):
        own = sorted(map(tuple, items.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g).collect()))
        if own:
            yield own


#: The automaton that this Python worker built last, by the name of its group: tasks that follow use it again.
_BUILT: dict[str, Benchmark] = {}


def _built(name: str, share: Broadcast) -> Benchmark:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Benchmark(share.value)
    return _BUILT[name]


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each span of a document that holds text of a test item.

    Whole texts are scanned, case, punctuation and white space aside. Null and empty texts match nothing; an empty
    benchmark gives an empty result. Items of two words or more are found as a whole, their lines from MIN_WORDS = 8 words
    on, runs of words from WINDOW = 13 on; items of a single word are not looked for. Items with equal texts are all reported. Repeated rows of `docs` are each
    answered; a null document id stays null, items with a null id are left out. Other columns are ignored.
    """
    cols = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = cols.where("false").selectExpr("id as doc_id", "id as item_id", "0 as span_start", "0 as span_end", "0 as n_words")
    for k, items in enumerate(_groups(bench, item_col, item_text_col)):
        share, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def make(share=share, name=name):
            known = _built(name, share)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                ids = batch["id"].to_pylist()
                rows = [(ids[i], *m) for i, t in enumerate(batch["text"].to_pylist()) for m in known.matches(t)]
                if not rows:
                    return None
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "span_start", "span_end", "n_words"])

            return each

        part = map_batches(cols, SCHEMA, make)
        out = out.unionByName(part) if k else part
    return out


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text holds no test item; no shuffle, no second scan.

    Rows with a null or empty text stay, as do all rows if the benchmark is empty. Items of a single word and, by
    themselves, lines of items with fewer than MIN_WORDS = 8 words remove nothing (see `contaminated`).
    """
    out = docs
    for items in _groups(bench, item_col, item_text_col):
        share, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
        place = out.columns.index(text_col)

        def make(share=share, name=name, place=place):
            known = _built(name, share)
            return lambda batch: batch.filter(pa.array([not known.marks(t) for t in batch.column(place).to_pylist()], pa.bool_()))

        out = map_batches(out, out.schema, make)
    return out
