from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geostrata.llm import exact_dedup
from geostrata.llm.queries import op10_exact_dedup, oracle_sql
from tests.compare import SMALL, oracle, rows


def test_oracle(spark):
    assert rows(op10_exact_dedup(spark, SMALL)) == oracle(oracle_sql()["op10_exact_dedup"], SMALL)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=300))
def test_filters_hold_all_their_keys(keys):
    f = exact_dedup.BinaryFuse.build(np.array(sorted(keys), np.uint64))
    assert all(f.contains(np.array(sorted(keys), np.uint64))) and all(k in f for k in list(keys)[:3])


def test_filters_hold_few_others():
    rng = np.random.default_rng(6)
    keys, others = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64), rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    f = exact_dedup.BinaryFuse.build(keys)
    assert f.contains(keys).all() and f.contains(others).mean() < 0.006 and len(f.prints) < 1.3 * len(keys)


def brute(table):
    """(doc, keep, rows) as the docstring says."""
    own = {}
    for r in table:
        if r.text is not None:
            own.setdefault(r.text, []).append(r.doc_id)
    out = []
    for ids in own.values():
        ids.sort(key=lambda x: (x is None, x))
        for x in set(ids):
            n = ids.count(x) - (x == ids[0])
            if n:
                out.append((x, ids[0], n))
    return sorted(out, key=str)


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("snapshots", [1, 4])
def test_odd_rows(odd, empty, monkeypatch, clash, snapshots):
    if clash:  # all texts have one digest, so their bytes decide
        monkeypatch.setattr(exact_dedup, "digest", lambda c: (F.length(c) * 0 + F.lit(7).cast("bigint"), F.lit(9).cast("bigint")))
    got = exact_dedup.duplicates(odd, snapshots=snapshots).collect()
    assert sorted(((r.doc_id, r.keep_id, r.n_rows) for r in got), key=str) == brute(odd.collect())
    assert exact_dedup.duplicates(empty, snapshots=snapshots).count() == 0


def test_rows_that_stay(odd, empty):
    out = exact_dedup.deduplicated(odd)
    assert out.schema == odd.schema
    got = out.collect()
    texts = [r.text for r in got if r.text is not None]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in odd.collect()} - {None}
    assert sum(r.text is None for r in got) == 2 and {5, 7} <= {r.doc_id for r in got} and not {6, 10} & {r.doc_id for r in got}
    assert exact_dedup.deduplicated(empty).count() == 0


def test_ids_over_the_whole_range(spark):
    ids = [-(1 << 63), -5, 0, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, "same") for i in ids], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.duplicates(docs).collect()) == [(i, ids[0]) for i in ids[1:]]


def test_copies_meet_the_filters_as_one(spark, monkeypatch):
    """One text that a million rows have: the grouped Python functions get it once a snapshot."""
    docs = spark.range(1_000_000).selectExpr("id as doc_id", "if(id % 1000 = 7, concat('text ', id), 'hot') as text")
    seen = []
    real = exact_dedup.screen
    monkeypatch.setattr(exact_dedup, "screen", lambda rows, filters: seen.append(rows.count()) or real(rows, filters))
    got = exact_dedup.duplicates(docs).agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum("n_rows")).first()
    assert tuple(got) == (998_999, 0, 0, 998_999) and seen == [750 + 3]


def test_snapshots_that_arrive_one_after_another(spark, odd, tmp_path):
    """Three batches, each screened against saved filters and then stored, by a new object each time."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    batches = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1").union(odd.select("doc_id", "text")), docs.union(docs.selectExpr("doc_id + 100000", "concat(text, '!')"))]
    known = {}
    for k, batch in enumerate(batches):
        store = exact_dedup.Snapshots(spark, str(tmp_path), 3)
        assert store.numbers() == list(range(k))
        got = sorted((tuple(r) for r in store.screened(batch).collect()), key=str)
        table = batch.collect()
        new = [r for r in table if r.text not in known]
        want = [(i, *known[t], n) for (i, t), n in Counter((r.doc_id, r.text) for r in table if r.text in known).items()]
        assert got == sorted([*want, *((i, keep, None, n) for i, keep, n in brute(new))], key=str)
        assert store.add(batch) == k
        for r in sorted(new, key=lambda r: (r.doc_id is None, r.doc_id)):
            if r.text is not None:
                known.setdefault(r.text, (r.doc_id, k))
    assert got


def test_an_unfinished_snapshot_does_not_count(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    store = exact_dedup.Snapshots(spark, str(tmp_path), 2)
    store.add(docs)
    (tmp_path / "filters/snapshot=0/_SUCCESS").unlink()
    assert store.numbers() == [] and store.screened(docs).count() == 0
    assert store.add(docs) == 0 and sorted(r.doc_id for r in store.screened(docs).collect()) == [1, 2]
    assert store.screened(docs.where("false")).count() == 0
