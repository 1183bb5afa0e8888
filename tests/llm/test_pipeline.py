import corpus_pipeline
from geostrata.llm import quality
from geostrata.llm.common import table
from tests.compare import SMALL
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_packing import checked
from tests.llm.test_similarity import brute, groups
from collections import Counter


def test_run_against_brute_force(spark):
    """Stage by stage in plain Python but for the classifier, whose scores are tested with it."""
    docs, bench = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    keep = {r.doc_id for r in quality.quality(docs, table(spark, SMALL, "labels")).collect() if r.keep}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep)
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    rows = [(i, t) for i, t in rows if first[t] == i]
    root = groups(brute(rows))
    rows = [(i, t) for i, t in rows if root.get(i, i) == i]
    dirty = {i for i, _ in contaminated(rows, [(r.item_id, r.text) for r in bench.collect()])}
    rows = [(i, t) for i, t in rows if i not in dirty]
    want = Counter({i: len(t.split()) for i, t in rows if t.split()})
    assert 50 < len(want) < docs.count()
    checked(corpus_pipeline.run(spark, SMALL).collect(), want, 2048)


def test_stages_return_documents(spark, odd, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, empty):
            out = stage(spark, docs, SMALL)
            assert out.schema == docs.schema, name
            assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SMALL).count() == 0
