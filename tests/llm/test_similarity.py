import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from geostrata.llm import queries, similarity


def brute(rows, threshold=similarity.THRESHOLD):
    sets = [(i, set(s.tolist())) for (i, _), s in zip(rows, similarity.features([t for _, t in rows])) if len(s)]
    out = {}
    for (a, x), (b, y) in combinations(sorted(sets, key=lambda s: s[0]), 2):
        if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and (j := len(x & y) / len(x | y)) >= threshold:
            out[a, b] = j
    return out


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def expanded(docs):
    """All similar pairs of ids, from the pairs of representatives and the membership."""
    pairs, members = similarity.similar_pairs(docs)
    own = {}
    for r in members.collect():
        own.setdefault(r.rep_id, []).append(r.doc_id)
    out = {(a, b): 1.0 for x in own.values() for a, b in combinations(sorted(x), 2)}
    return out | {tuple(sorted((a, b))): r.jaccard for r in pairs.collect() for a in own[r.doc_a] for b in own[r.doc_b]}


def counted(docs):
    return {r.doc_id: (r.class_id, r.n_links) for r in similarity.links(docs).collect()}


def expected(ids, pairs):
    root, degree = groups(pairs), Counter(x for p in pairs for x in p)
    return {i: (root.get(i, i), degree[i]) for i in ids}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = [r.doc_id for r in docs.collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = expanded(docs)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 50
    assert all(abs(j - want[p]) < 1e-9 for p, j in got.items())
    assert {r.doc_id: (r.class_id, r.n_links) for r in queries.op7_ngram_jaccard_join(spark, "/root/testdata/sf0.01").collect()} == expected(ids, got)
    kept = {r.doc_id for r in similarity.deduplicated(docs).collect()}
    root = groups(got)
    assert kept == set(ids) - {x for x, r in root.items() if x != r}


def test_recall_near_the_threshold(spark):
    """Pairs of edited copies from just above the threshold up, of texts of very different lengths."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([30, 80, 300, 1500]))]
        other = list(words)
        for k in range(0, len(other), rng.choice([13, 20, 40])):
            other[k] = f"x{rng.randint(0, 10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = expanded(docs)
    assert len(want) > 250 and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert counted(docs) == expected(range(800), got)


@pytest.mark.parametrize("small", [False, True])
def test_no_pair_at_the_threshold_is_missed(spark, monkeypatch, small):
    """Pairs that reach the threshold exactly or by a little, in groups that share text with others and by themselves, are
    all found; also where sets are counted in many chunks and places."""
    if small:
        monkeypatch.setattr(similarity, "CHUNK", 5000)
        monkeypatch.setattr(similarity, "PLACE", 3000)
    rng, rows = random.Random(17), []
    common = [[f"c{k}w{i}" for i in range(40)] for k in range(5)]  # passages that many texts have
    for i in range(500):
        size = rng.choice([4, 12, 50, 202, 600])
        words = [f"d{i}w{k}" for k in range(size)]
        if size >= 50 and i % 3 == 0:
            words[:10] = rng.choice(common)[:10]
        changed = (size - 2) // 4  # of the n-grams, at the end: similarity (1 - x) / (1 + x), 0.6 for a quarter
        rows += [words, [*words[: size - changed], *(f"x{i}w{k}" for k in range(changed))]]
    rows = list(enumerate(map(" ".join, rows)))
    want = brute(rows)
    close = sum(j < 0.62 for j in want.values())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = expanded(docs)
    assert len(want) >= 400 and close >= 300 and got.keys() == want.keys()
    assert counted(docs) == expected(range(1000), want)
    root = groups(want)
    assert {r.doc_id for r in similarity.deduplicated(docs).collect()} == {i for i in range(1000) if root.get(i, i) == i}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.0])
def test_similar_sets_share_what_is_needed(threshold):
    for a in range(1, 60):
        for b in range(a, 60):
            for both in range(1, a + 1):
                if both / (a + b - both) >= threshold - 1e-12:
                    assert both >= similarity.least_shared(np.array([a, b]), threshold).max()


def test_large_groups(spark, monkeypatch):
    """A group of copies that takes many tiles; every pair is found, and counted once."""
    monkeypatch.setattr(similarity, "TILE", 16)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(150)] + [(1000 + i, " ".join(rng.sample(base, 60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute(rows)
    assert len(want) == 150 * 149 // 2 and set(expanded(docs)) == set(want)
    assert counted(docs) == expected([i for i, _ in rows], want)
    assert {r.doc_id for r in similarity.deduplicated(docs).collect()} == {0, *range(1000, 1020)}


@pytest.mark.parametrize("seed", [1])
def test_chains_keep_one_of_each_group(spark, monkeypatch, seed):
    """Texts that drift away from their first copy: links that don't go through a lead decide what belongs together."""
    monkeypatch.setattr(similarity, "TILE", 4)
    rng, rows = random.Random(seed), []
    for c in range(8):
        words = [f"c{c}w{k}" for k in range(120)]
        for i in range(12):
            rows.append((len(rows), " ".join(words)))
            for k in rng.sample(range(120), rng.choice([2, 5, 9])):
                words[k] = f"x{rng.randint(0, 10**9)}"
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs = expanded(docs)
    assert counted(docs) == expected(range(len(rows)), pairs)
    root = groups(pairs)
    assert {r.doc_id for r in similarity.deduplicated(docs).collect()} == {i for i, _ in rows if root.get(i, i) == i}


def test_one_cluster_is_sent_once(spark, monkeypatch):
    """Near copies of one text: what is compared with the lead is as much as there are copies, and nothing is left."""
    monkeypatch.setattr(similarity, "TILE", 8)
    base = [f"w{k}" for k in range(80)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"end{i}"])) for i in range(400)], "doc_id bigint, text string")
    sent = []
    real = similarity._with_features
    monkeypatch.setattr(similarity, "_with_features", lambda rows, *a: sent.append(rows.count()) or real(rows, *a))
    assert similarity.deduplicated(docs).count() == 1
    assert len(sent) == 1 and sent[0] < 1.3 * 400 * 2  # a text may have a second lead, by a signature that its first has not


def test_signatures_are_shared_within_the_bound():
    rng = np.random.default_rng(5)
    n = similarity.PARTS * similarity.SUBPARTS
    bound = similarity.PARTS * (similarity.SUBPARTS - similarity.AGREE + 1) - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 60, n).astype(np.uint64)
        b = a.copy()
        b[rng.choice(n, bound, replace=False)] += np.uint64(1)
        row, sig = similarity.signatures(np.stack([a, b]), np.array([100.0, 104.0]), similarity.THRESHOLD)
        assert set(sig[row == 0]) & set(sig[row == 1])


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 1.0])
def test_similar_sizes_share_a_band(threshold):
    for size in range(1, 400):
        for other in range(size, int(size / threshold) + 1):
            (a, b), (more, _) = similarity.bands(np.array([size, other], float), threshold)
            assert a == b or (b == a + 1 and more)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)]
    got = {r.id: r.root for r in similarity.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = groups(e for e in edges if e[0] != e[1])
    assert {k: got.get(k, k) for k in want} == want
    assert similarity.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_clashing_ids(spark):
    base, other = [f"w{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    near, far, copy = [*base[:-1], "x"], ["z", *other[:-1]], other
    rows = [(1, base), (2, near), (2, [f"clean{i}" for i in range(30)]), (2, []), (3, other), (4, far), (4, near), (5, copy), (5, far), (6, base), (6, near), (6, base), (7, [f"u{i}" for i in range(9)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(2, None)], "doc_id bigint, text string")
    once = sorted({(i, " ".join(w)) for i, w in rows})
    want = expected(range(len(once)), brute(list(enumerate(t for _, t in once))))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in similarity.links(docs).collect())
    lowest = {}
    for k, (c, _) in want.items():
        lowest[c] = min(lowest.get(c, 99), once[k][0])
    assert got == sorted([(once[k][0], lowest[c], n) for k, (c, n) in want.items()] + [(2, 2, 0)])
    kept = sorted((r.doc_id, r.text or "") for r in similarity.deduplicated(docs).collect())
    assert kept == sorted([(1, " ".join(base)), (2, " ".join(rows[2][1])), (2, ""), (2, ""), (3, " ".join(other)), (7, " ".join(rows[-1][1]))])


def test_odd_rows(odd, empty):
    assert expanded(odd) == {(5, 6): 1.0, (5, 9): 1.0, (6, 9): 1.0, (7, 10): 1.0}
    rows = odd.where("doc_id is not null").select("doc_id", "text").distinct().collect()
    got = similarity.links(odd).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    assert {(r.doc_id, r.class_id, r.n_links) for r in got if r.n_links} == {(5, 5, 2), (6, 5, 2), (9, 5, 2), (7, 7, 1), (10, 7, 1)}
    out = similarity.deduplicated(odd)
    assert out.schema == odd.schema
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect() if r.doc_id not in (6, 9, 10))
    assert similarity.links(empty).count() == 0 and similarity.deduplicated(empty).count() == 0
