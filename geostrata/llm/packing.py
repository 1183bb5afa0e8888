"""Best-fit packing: documents into bins of a fixed size, improved by swap-based local search."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Words that a bin (a training sequence) holds.
CAPACITY = 2048
#: Pieces that are packed together on average; the loss of packing in groups is about one bin a group.
GROUP_PIECES = 4_000

SCHEMA = "bin_id string, doc_id bigint, piece int, piece_start bigint, n_words bigint, bin_offset bigint, bin_fill bigint"


def word_count(text: Column) -> Column:
    """Words between white space, 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


class Bins:
    """Items (sizes) in bins of one capacity. Bins that are full or empty are out of the search."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.members: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit_decreasing(self) -> None:
        free: list[tuple[int, int]] = []  # (room, bin), sorted
        for i in np.argsort(-self.sizes, kind="stable").tolist():
            s = int(self.sizes[i])
            at = bisect_left(free, (s, -1))
            if at < len(free):
                room, b = free.pop(at)
                self.members[b].append(i)
                self.fill[b] += s
            else:
                b, room = len(self.members), self.capacity
                self.members.append([i])
                self.fill.append(s)
            if room > s:
                insort(free, (room - s, b))

    def local_search(self) -> int:
        """Moves, one-for-one and two-for-one exchanges (either way) between underfull bins while one of them raises the
        sum of squared fills; the emptiest bins give first, until they are empty. Returns the number of steps taken.

        It ends, as each step raises a bounded whole number, and then no such step is left between any two bins.
        """
        steps = 0
        self._sets = {b: self._offers(b) for b, f in enumerate(self.fill) if 0 < f < self.capacity}
        self._flat = None
        while True:
            before = steps
            for a in sorted(self._sets, key=lambda b: (self.fill[b], b)):
                while a in self._sets and (step := self._best_step(a)) is not None:
                    self._apply(a, *step)
                    steps += 1
            if steps == before:
                return steps

    def _apply(self, a: int, b: int, give: list[int], take: list[int]) -> None:
        for x, y, items in ((a, b, give), (b, a, take)):
            for i in items:
                self.members[x].remove(i)
                self.members[y].append(i)
                self.fill[x] -= int(self.sizes[i])
                self.fill[y] += int(self.sizes[i])
        for x in (a, b):
            if 0 < self.fill[x] < self.capacity:
                self._sets[x] = self._offers(x)
            else:
                self._sets.pop(x, None)
        self._flat = None

    def _best_step(self, a: int) -> tuple[int, list[int], list[int]] | None:
        """The step from bin `a` that raises the sum of squared fills most: (bin, items given, items taken).

        Giving d more than is taken raises the sum by 2d(fill_b - fill_a + d), for 0 < d <= room of b; for what is
        taken from b, the largest offer of `a` that fits is best, and at most one side gives two items.
        """
        if self._flat is None:
            keys = list(self._sets)
            sizes = [len(self._sets[b][0]) for b in keys]
            owner = np.repeat(keys, sizes)
            self._flat = (owner, *(np.concatenate([self._sets[b][k] for b in keys]) for k in range(2)), np.array(self.fill)[owner])
        owner, sums, count, fill = self._flat
        own, kinds = self._sets[a]
        best, gain = None, 0
        lead, most = fill - self.fill[a], sums + (self.capacity - fill)
        for pairs in (False, True):  # offers of one item against all, offers of two against one item
            offers = np.unique(own[kinds == 1 + pairs])
            use = (owner != a) & ((count == 1) if pairs else True)
            at = np.searchsorted(offers, most, side="right") - 1
            use &= at >= 0
            if not use.any():
                continue
            d = np.where(use, offers[np.maximum(at, 0)] - sums, 0)
            value = np.where(d > 0, 2 * d * (lead + d), 0)
            k = int(value.argmax())
            if value[k] > gain:
                gain, b = int(value[k]), int(owner[k])
                best = (b, self._pick(a, int(offers[at[k]]), 1 + pairs), self._pick(b, int(sums[k]), int(count[k])))
        return best

    def _offers(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums and numbers of items of what a bin can give: nothing, one item, or two."""
        own = np.sort(self.sizes[self.members[b]])
        one = np.unique(own)
        x, y = np.triu_indices(len(one), 1)
        twice = one[np.searchsorted(own, one, side="right") - np.searchsorted(own, one) > 1]
        two = np.unique(np.concatenate([one[x] + one[y], 2 * twice]))
        return np.concatenate([[0], one, two]), np.repeat([0, 1, 2], [1, len(one), len(two)])

    def _pick(self, b: int, total: int, count: int) -> list[int]:
        """Items of a bin, `count` of them, that sum up to `total`."""
        if not count:
            return []
        seen: dict[int, int] = {}
        for i in self.members[b]:
            s = int(self.sizes[i])
            if count == 1 and s == total:
                return [i]
            if count == 2 and total - s in seen:
                return [seen[total - s], i]
            seen.setdefault(s, i)
        raise AssertionError("no such items")


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, total) of the documents with words."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), word_count(F.col(text_col)).alias("total")).where("total > 0")


def pieces(rows: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, piece_start, n): documents (id, total) cut where they exceed the capacity; the last piece is what is left."""
    rows = rows.select("id", "total", F.explode(F.sequence(F.lit(0), ((F.col("total") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece") * F.lit(capacity).cast("bigint")
    return rows.select("id", "piece", start.alias("piece_start"), F.least(F.lit(capacity).cast("bigint"), F.col("total") - start).alias("n"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece of a document: its bin, its first word and number of words, its place in the bin.

    Texts are read once, to count their words; only ids and lengths are written and move: pieces are spread over groups by a hash of id and number, and each group is packed on
    its own, by best fit in decreasing order and then local search (see Bins). A piece of a document that is longer
    than `capacity` fills a bin by itself. Documents without words (null, empty, blank) take no place. Repeated rows
    are packed as often as they occur; a null id is packed like any other; other columns are ignored. An empty table
    gives an empty result.
    """
    rows = checkpointed(lengths(docs, id_col, text_col))
    parts = pieces(rows, capacity)
    full = parts.where(F.col("n") == capacity).select(
        F.concat(F.lit("f"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("-"), F.col("piece")).alias("bin_id"), F.col("id").alias("doc_id"), "piece", "piece_start", F.col("n").alias("n_words"), F.lit(0).cast("bigint").alias("bin_offset"), F.col("n").alias("bin_fill")
    )
    rest = parts.where(F.col("n") < capacity)
    n = rows.count()
    groups = max(1, -(-n // group_pieces))
    rest = rest.withColumn("group", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins = Bins(pdf["n"].to_numpy(), capacity)
        bins.best_fit_decreasing()
        bins.local_search()
        order, name, offset, fill = [], [], [], []
        g = int(pdf["group"].iloc[0])
        for b, members in enumerate(bins.members):
            at = 0
            for i in members:
                order.append(i)
                name.append(f"g{g}-{b}")
                offset.append(at)
                fill.append(bins.fill[b])
                at += int(bins.sizes[i])
        got = pdf.iloc[order]
        return pd.DataFrame({"bin_id": name, "doc_id": got["id"].to_numpy(), "piece": got["piece"].to_numpy(), "piece_start": got["piece_start"].to_numpy(), "n_words": got["n"].to_numpy(), "bin_offset": offset, "bin_fill": fill}).astype({"doc_id": "Int64"})

    return full.unionByName(rest.groupBy("group").applyInPandas(run, SCHEMA))
