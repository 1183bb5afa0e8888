import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from geostrata.llm import language_id, queries
from tests.compare import SMALL


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    model = language_id.fit(docs.where(~held))
    got = language_id.identify(docs.where(held), *model).join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert len(got) > 300 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_scores_against_one_gram_at_a_time():
    texts = ["abc", "", None, "ABC 123", "x" * 10, "漢字\U0001f600"]
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(1 << language_id.BITS, 3)).astype(np.float32)
    scores, grams = language_id.score_texts(texts, matrix)
    for k, t in enumerate(texts):
        t = language_id.normal(t)
        want, n = np.zeros(3), 0
        for order, buckets in zip(language_id.ORDERS, language_id.gram_buckets(t)):
            for i in range(len(t)):
                alone = language_id.gram_buckets((t + "\0\0")[i : i + order])[language_id.ORDERS.index(order)][0]
                assert alone == buckets[i]
                want += matrix[alone]
                n += 1
        assert np.allclose(scores[k], want, atol=1e-4) and grams[k] == n


def test_long_texts_are_read_whole(monkeypatch):
    matrix = np.random.default_rng(4).normal(size=(1 << language_id.BITS, 2)).astype(np.float32)
    t = "".join(map(chr, np.random.default_rng(5).integers(97, 123, language_id.CHUNK + 100)))
    got, grams = language_id.score_texts([t], matrix)
    monkeypatch.setattr(language_id, "CHUNK", 10 * len(t))
    whole, n = language_id.score_texts([t], matrix)
    assert np.allclose(got, whole, atol=1e-6) and grams[0] == n[0] == len(t) * len(language_id.ORDERS)


def slow_bucket(gram, order):
    h, m = 0, 0xFFFFFFFF
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B1 & m
        h ^= h >> 15
    return ((h * 0x85EBCA6B + order - 1) & m) >> (32 - language_id.BITS)


def test_query_against_brute_force(spark):
    """Counts in dictionaries, one n-gram at a time, over all documents (there are fewer than MAX_TRAIN)."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert len(rows) < language_id.MAX_TRAIN

    def grams(text):
        t = "".join("0" if c in "123456789" else c for c in (text or "").lower()) + "\0\0"
        return [slow_bucket(t[i : i + k], k) for k in language_id.ORDERS for i in range(len(t) - 2)]

    found = {i: Counter(grams(t)) for i, t, _ in rows}
    counts, docs = {}, Counter(x for _, t, x in rows if x is not None and t)
    for i, _, x in rows:
        if x is not None:
            counts.setdefault(x, Counter()).update(found[i])
    total = {x: c.total() + language_id.SMOOTHING * 2**language_id.BITS for x, c in counts.items()}
    got = {r.doc_id: r for r in queries.op3_language_id(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        n = found[i].total()
        if not n:
            assert got[i].lang_pred == "und" and got[i].log_prob is None
            continue
        scores = {x: math.log((docs[x] + 1) / (docs.total() + len(docs))) + sum(k * math.log((counts[x][b] + language_id.SMOOTHING) / total[x]) for b, k in found[i].items()) for x in counts}
        best, second = sorted(scores.values(), reverse=True)[:2]
        assert abs(got[i].log_prob - best / n) < 1e-4 and abs(got[i].margin - (best - second) / n) < 1e-4
        assert got[i].lang_pred == max(sorted(scores), key=scores.get) or best - second < 1e-3


def test_odd_rows(spark, odd, empty):
    out = language_id.language_id(odd).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    assert by[1].lang_pred == by[2].lang_pred == "und" and by[1].log_prob is None and by[5].lang_pred == "en" and by[4].lang_pred == "en"
    assert language_id.language_id(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.language_id(unlabelled).collect()} == {"und"}


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same text", "zz"), (2, "same text", "aa")], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in language_id.language_id(docs).collect()} == {"aa"}
