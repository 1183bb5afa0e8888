import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from geostrata.llm import line_dedup
from geostrata.llm.queries import op6_line_dedup, oracle_sql
from tests.compare import SMALL, oracle, rows


def test_oracle(spark):
    assert rows(op6_line_dedup(spark, SMALL)) == oracle(oracle_sql()["op6_line_dedup"], SMALL)


@given(st.lists(st.booleans()))
def test_bitmaps(keep):
    runs = line_dedup.encode(np.array(keep, bool))
    assert line_dedup.decode(runs).tolist() == keep
    text = "\n".join(f"l{i}" for i in range(len(keep)))
    if keep:
        assert line_dedup.apply(text, runs) == "\n".join(f"l{i}" for i, k in enumerate(keep) if k)


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_odd_rows(spark, odd, empty, batch):
    seen, want = set(), []
    for doc, text in sorted(((r.doc_id, r.text) for r in odd.collect() if r.text is not None), key=lambda x: (x[0] is None, x[0])):
        keep = []
        for line in text.split("\n"):
            line = line.strip(" \t\r")
            keep.append(not line or line not in seen)
            seen.add(line)
        want.append((doc, len(keep), sum(keep), line_dedup.encode(np.array(keep))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in line_dedup.keep_bitmaps(odd).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert line_dedup.keep_bitmaps(empty).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_line_that_all_have(spark):
    docs = spark.createDataFrame([(i, f"all rights reserved\nown {i}\n\nall rights reserved ") for i in range(3000)], "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.keep_bitmap for r in line_dedup.keep_bitmaps(docs).collect()}
    assert got == {i: "3,1" if i == 0 else "0,1,2,1" for i in range(3000)}
