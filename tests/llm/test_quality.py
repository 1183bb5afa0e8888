import itertools
import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geostrata.llm import quality, queries
from tests.compare import SMALL

SF = "/root/testdata/sf0.1"


def test_pair_sum_is_the_double_loop():
    rng = np.random.default_rng(1)
    m = quality.Machine(np.arange(50), 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    docs = [rng.choice(50, k, replace=False) for k in (0, 1, 2, 9, 30)]
    want = [m.w0 + m.w[d].sum() + sum(m.v[i] @ m.v[j] for k, i in enumerate(d) for j in d[k + 1 :]) for d in docs]
    assert np.allclose(m.scores(np.concatenate(docs).astype(int), np.array([len(d) for d in docs])), want)


def slow_mix(h):
    m = (1 << 64) - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
    h = (h ^ h >> 27) * 0x94D049BB133111EB & m
    return h ^ h >> 31


def slow_buckets(word):
    w = word.lower().strip(quality._STRIP)
    of = lambda part, k: slow_mix(sum(slow_mix(ord(c) | i << 32) for i, c in enumerate(part)) % 2**64 ^ k * 0x9E3779B97F4A7C15 % 2**64) % quality.BUCKETS
    return {of(w, 0), *(of(w[:k], n + 1) for n, k in enumerate(quality.PREFIXES) if len(w) >= k)}


def slow_features(text, lang, source):
    """Buckets of one text, word by word."""
    text = text or ""
    words = text.split()
    longest = max((len(list(g)) for _, g in itertools.groupby(words)), default=0)
    out = {b for w in words for b in slow_buckets(w)}
    return sorted(out | {quality.name_bucket(x) for x in quality.structure(text, len(words), len(set(words)), longest, lang, source)})


def test_features_against_a_loop_over_words(monkeypatch):
    texts = ["a a a b  a", None, "", "  \n\t ", "\nVersion 1.2, VERSIONS!\n\nend ", "漢字 ünï \u00a0 x\u2003y", "word " * 50 + "other"] * 3
    langs, sources = ["en", None, "de"] * 7, [None, "web", "x"] * 7
    want = [slow_features(*x) for x in zip(texts, langs, sources)]
    for size in (quality.SLICE, 20):
        monkeypatch.setattr(quality, "SLICE", size)
        value, sizes = quality.Features().of(pa.array(texts), pa.array(langs), pa.array(sources))
        assert [x.tolist() for x in np.split(value, np.cumsum(sizes)[:-1])] == want
        place = {b: i for i, b in enumerate(sorted({b for w in want for b in w})[::2])}
        value, sizes = quality.Features(np.array([*place])).of(pa.array(texts), pa.array(langs), pa.array(sources))
        assert [x.tolist() for x in np.split(value, np.cumsum(sizes)[:-1])] == [[place[b] for b in w if b in place] for w in want]


def test_features_of_stretches_against_a_loop_over_words(monkeypatch):
    texts = ["a a a b  a", None, "", "  \n\t ", " b b end\n", "word " * 50 + "other", " c d e f  b b b b"] * 5
    want = [slow_features(t, "en", None) for t in texts]
    for size in (1, 3, 7, 60):
        monkeypatch.setattr(quality, "STRETCH", size)
        value, sizes = quality.Features().of(pa.array(texts), pa.array(["en"] * 35), pa.nulls(35, pa.string()))
        assert [x.tolist() for x in np.split(value, np.cumsum(sizes)[:-1])] == want


def test_features_take_little_memory():
    """A slice of many texts takes a few times its size beside its result; it had taken 16 times, and 8 with buckets."""
    rng = np.random.default_rng(3)
    words = np.array([f"word{i * 7919}" for i in range(60_000)])
    texts = pa.array([" ".join(words[rng.integers(0, len(words), 300)]) for _ in range(1_800)])
    names = pa.array(["en"] * len(texts))
    for buckets in (None, np.arange(0, quality.BUCKETS, 1 << 20)):
        tracemalloc.start()
        value, sizes = quality.Features(buckets).of(texts, names, names)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(sizes) == len(texts) and peak - 2 * value.nbytes < 6 * texts.nbytes < 6 * quality.SLICE


def test_carry_sends_texts_once(spark, odd):
    machine = quality.fit(odd, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    sent = lambda docs: quality.classify(docs, machine, carry=True)._jdf.queryExecution().analyzed().toString()
    assert "__fm_" not in sent(odd)
    other = odd.drop("source").withColumn("lang", F.lit(3))
    assert all(f"__fm_{c}" in sent(other) for c in ("lang", "source")) and "__fm_text" not in sent(other)
    out = quality.classify(other, machine, carry=True)
    assert out.schema == other.schema and sorted(map(str, out.collect())) == sorted(map(str, other.collect()))


def test_query_against_brute_force(spark):
    """Features, their choice and the scores as loops; the weights are those of `train`."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "labels"))
    feats = {r.doc_id: slow_features(r.text, r.lang, r.source) for r in docs}
    texts = {r.doc_id: r.text for r in docs}
    good, seen = {}, set()
    for r in sorted(labels, key=lambda r: r.doc_id):
        if r.quality is not None and r.doc_id in texts:
            good[r.doc_id] = min(good.get(r.doc_id, 1), int(r.quality == 1 and not r.toxic))
    rows = [i for i in sorted(good) if texts[i] not in seen and not seen.add(texts[i])]
    n, rate = len(rows), sum(good[i] for i in rows) / len(rows)
    have = Counter(b for i in rows for b in feats[i])
    hits = Counter(b for i in rows for b in feats[i] if good[i])
    chosen = sorted(b for b, d in have.items() if quality.MIN_DOCS <= d < n and (hits[b] - d * rate) ** 2 / (d * rate * (1 - rate)) * n / (n - d) >= quality.MIN_CHI2)
    place = {b: k for k, b in enumerate(chosen)}
    own = lambda i: [place[b] for b in feats[i] if b in place]
    m = quality.train(np.array(chosen), [np.array(own(i), np.int64) for i in rows], np.array([float(good[i]) for i in rows]))
    got = {r.doc_id: r for r in queries.op1_quality_classifier(spark, SMALL).collect()}
    assert got.keys() == feats.keys() and len(chosen) > 3
    for i in feats:
        x = own(i)
        z = m.w0 + sum(m.w[a] for a in x) + sum(m.v[a] @ m.v[b] for k, a in enumerate(x) for b in x[k + 1 :])
        p = 1 / (1 + math.exp(-z))
        assert abs(got[i].p_good - p) < 1e-6 and (got[i].keep == (p >= 0.5) or abs(p - 0.5) < 1e-6)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    got = quality.quality(docs, labels.where(~held)).join(labels.where(held), "doc_id").select("keep", "quality", "toxic").collect()
    good = [r.keep for r in got if r.quality == 1 and r.toxic == 0]
    bad = [r.keep for r in got if r.quality == 0 or r.toxic == 1]
    assert len(got) > 600 and np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 0, "x"), (7, 0, 0, "x"), (8, None, 1, None), (None, 1, 1, "y"), (6, 1, None, "z"), (6, 0, 0, "z")], "doc_id bigint, quality int, toxic int, text string")
    out = quality.quality(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.p_good <= 1 and r.keep == (r.p_good >= 0.5) for r in out)
    assert len({r.p_good for r in out if r.doc_id == 5}) == 1
    assert quality.quality(empty, labels).count() == 0


def test_without_both_classes_all_or_none_stay(spark, odd):
    schema = "doc_id bigint, quality int, toxic int"
    assert all(r.keep for r in quality.quality(odd, spark.createDataFrame([], schema)).collect())
    assert all(r.keep for r in quality.quality(odd, spark.createDataFrame([(5, 1, 0)], schema)).collect())
    assert not any(r.keep for r in quality.quality(odd, spark.createDataFrame([(5, 1, 1)], schema)).collect())


def test_carry_keeps_all_columns(spark, odd):
    machine = quality.fit(odd, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    out = quality.classify(odd, machine, carry=True)
    assert out.schema == odd.schema and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert quality.classify(odd, machine, threshold=1.1, carry=True).count() == 0


def test_batch_size_does_not_matter(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = quality.fit(docs, labels)
    one = {r.doc_id: r.p_good for r in quality.classify(docs, m).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        two = {r.doc_id: r.p_good for r in quality.classify(docs, m).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
