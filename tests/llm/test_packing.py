from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geostrata.llm import packing


def checked(rows, want: Counter, capacity: int):
    """All words of all documents are in bins once, without gaps or overlaps, and no bin holds too many."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        docs[r.doc_id].append((r.piece_start, r.n_words))
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at and r.bin_fill <= capacity
            at += r.n_words
        assert at == members[0].bin_fill
    for doc, total in want.items():
        assert sum(n for _, n in docs.pop(doc, [])) == total
    assert not docs
    return bins


@pytest.mark.parametrize("capacity", [50, packing.CAPACITY])
def test_documents(spark, capacity):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = Counter({r.doc_id: len(r.text.split()) for r in docs.collect() if r.text.split()})
    bins = checked(packing.pack(docs, capacity=capacity).collect(), want, capacity)
    assert len(bins) <= 1.02 * sum(want.values()) / capacity + 1


def test_odd_rows(odd, empty):
    want = Counter()
    for r in odd.collect():
        if r.text and r.text.split():
            want[r.doc_id] += len(r.text.split())
    checked(packing.pack(odd, capacity=100).collect(), want, 100)
    assert packing.pack(empty).count() == 0


def steps_left(bins: packing.Bins) -> int:
    """Moves and exchanges, one or two items for none, one or two (not two for two), that would raise the squares."""
    live = [b for b, f in enumerate(bins.fill) if 0 < f < bins.capacity]
    sets = {b: [(sum(bins.sizes[list(c)]), k) for k in range(3) for c in combinations(bins.members[b], k)] for b in live}
    found = 0
    for a in live:
        for b in live:
            if a != b:
                for give, i in sets[a]:
                    for take, j in sets[b]:
                        d = give - take
                        if d > 0 and i + j < 4 and (i, j) != (2, 2) and bins.fill[b] + d <= bins.capacity and d * (bins.fill[b] - bins.fill[a] + d) > 0:
                            found += 1
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 19), min_size=1, max_size=40))
def test_local_search(sizes):
    bins = packing.Bins(np.array(sizes), 20)
    bins.best_fit_decreasing()
    before = sum(f * f for f in bins.fill), sum(f > 0 for f in bins.fill)
    bins.local_search()
    after = sum(f * f for f in bins.fill), sum(f > 0 for f in bins.fill)
    assert sorted(i for m in bins.members for i in m) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in m) == f <= 20 for m, f in zip(bins.members, bins.fill))
    assert after[0] >= before[0] and after[1] <= before[1] and steps_left(bins) == 0


def test_it_empties_a_bin():
    bins = packing.Bins(np.array([6, 4, 7, 3, 2]), 11)
    bins.members, bins.fill = [[0, 4], [1, 3], [2]], [8, 7, 7]
    bins.local_search()
    assert sum(f > 0 for f in bins.fill) == 2
