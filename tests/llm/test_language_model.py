import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geostrata.llm import language_model as lm
from geostrata.llm import queries
from tests.compare import SMALL


class Slow:
    """The same model from dictionaries, one byte and one order at a time."""

    def __init__(self, texts, order=lm.ORDER, min_count=lm.MIN_COUNT):
        self.order = order
        counts = Counter(t[i : i + k] for t in texts for k in range(1, order + 1) for i in range(len(t) - k + 1))
        follow = {}
        for g, c in counts.items():
            follow.setdefault(g[:-1], {})[g[-1]] = c
        self.arcs = {}
        for h, nexts in follow.items():
            kept = {w: c for w, c in nexts.items() if c >= min_count[len(h)]}
            if kept or not h:
                total = sum(nexts.values()) + len(kept)
                self.arcs[h] = ({w: c / total for w, c in kept.items()}, 1 - sum(kept.values()) / total)

    def p(self, h, w):
        if h not in self.arcs:
            return self.p(h[1:], w)
        alpha, weight = self.arcs[h]
        return alpha.get(w, 0) + weight * (self.p(h[1:], w) if h else 1 / 256)

    def score(self, t):
        """An arc has the interpolated probability; without one the weight of backing off is paid."""
        total, fails = 0.0, 0
        for i, w in enumerate(t):
            h = t[max(0, i - self.order + 1) : i]
            while h not in self.arcs:
                h = h[1:]
            while True:
                alpha, weight = self.arcs[h]
                if w in alpha:
                    total += np.log2(self.p(h, w))
                    break
                total += np.log2(weight)
                if not h:
                    total -= 8
                    break
                fails += 1
                h = h[1:]
                while h not in self.arcs:
                    h = h[1:]
        return total, fails


def automaton(texts):
    return lm.Automaton(*lm.smooth(*lm.ngram_counts(texts)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=40) | st.text("ab", max_size=60).map(str.encode), min_size=1, max_size=8))
def test_against_the_slow_model(texts):
    if not any(texts):
        return
    slow, got = Slow(texts), automaton(texts).score(texts)
    want = [slow.score(t) for t in texts]
    assert np.allclose(got[0], [w[0] for w in want], atol=1e-6) and got[1].tolist() == [w[1] for w in want]


def test_probabilities_sum_to_one():
    slow = Slow([b"abracadabra", b"banana bandana"])
    for h in (b"", b"a", b"an", b"bra", b"zz", b"anan"):
        assert abs(sum(slow.p(h, w) for w in range(256)) - 1) < 1e-9


def test_long_texts_are_one_traversal(monkeypatch):
    t = bytes(np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8))
    a = automaton([t])
    whole = Slow([t]).score(t)
    monkeypatch.setattr(lm, "LANE", 37)
    monkeypatch.setattr(lm, "CHUNK", 113)
    got = a.score([t])
    assert abs(got[0][0] - whole[0]) < 1e-6
    again = lm.ngram_counts([t, b"", b"a"])
    monkeypatch.undo()
    want = lm.ngram_counts([t, b"", b"a"])
    assert all((x == y).all() for x, y in zip(again, want))


@pytest.mark.parametrize("size, fanout", [(lm.SHARD_BYTES, lm.FANOUT), (30_000, lm.FANOUT), (12_000, 2)])
def test_shards_and_documents(spark, size, fanout):
    """One shard, many, and many that merge in several steps give the scores of the slow model."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 3000")
    rows = {r.doc_id: r.text.encode() for r in docs.collect()}
    if fanout == 2:
        assert lm.steps(-(-sum(map(len, rows.values())) // size), fanout)[0] >= 3
    slow = Slow(list(rows.values()))
    got = {r.doc_id: r for r in lm.score(docs, shard_bytes=size, fanout=fanout).collect()}
    assert got.keys() == rows.keys() and len(rows) > 100
    for i, r in got.items():
        want, fails = slow.score(rows[i])
        assert abs(r.log2_prob - want) < 1e-4 * abs(want) + 1e-3 and r.backoffs == fails
        assert r.n_bytes == len(rows[i]) and abs(r.bits_per_byte + r.log2_prob / r.n_bytes) < 1e-9


def test_query(spark):
    rows = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = dict(zip(rows, zip(*automaton(list(rows.values())).score(list(rows.values())))))
    got = queries.op5_lm_scoring(spark, SMALL).collect()
    assert len(got) == len(rows)
    assert all(abs(r.log2_prob - want[r.doc_id][0]) < 1e-4 * abs(want[r.doc_id][0]) + 1e-3 and r.backoffs == want[r.doc_id][1] for r in got)


def test_rows_grow_as_the_shards():
    for shards in (1, 3, 32, 1000, 6_250_000, 10**8):
        levels, split, group = lm.steps(shards)
        assert split <= lm.FANOUT and split**levels >= shards / lm.SHARDS_PER_BUCKET and group**levels >= shards
        rows = sum(-(-shards // group**k) * split ** (k + 1) for k in range(levels))  # sent up by the groups of each step
        assert levels <= 1 + math.log(max(shards, 2), 16) and rows <= 4 * shards * levels * lm.FANOUT


def test_repeated_rows_are_spread(spark, monkeypatch):
    """A row that occurs very often is in all shards, so none of them has to hold all of it."""
    docs = spark.createDataFrame([(1, "the same text again")], "doc_id bigint, text string").selectExpr("doc_id", "text", "explode(sequence(1, 4000)) as n")
    held = []
    real = lm._model
    monkeypatch.setattr(lm, "_model", lambda counted, *a: held.append(counted.count()) or real(counted, *a))
    got = lm.score(docs, shard_bytes=8_000).collect()
    assert len(got) == 4000 and len({round(r.log2_prob, 6) for r in got}) == 1 and held[0] >= 10


def test_odd_rows(odd, empty):
    got = lm.score(odd, shard_bytes=5_000).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].log2_prob is None and by[1].n_bytes == 0 and by[2].bits_per_byte is None and by[4].n_bytes > 1_000_000 and by[4].bits_per_byte < 8
    assert len({r.log2_prob for r in got if r.doc_id in (5, 6)}) == 1
    assert lm.score(empty).count() == 0
