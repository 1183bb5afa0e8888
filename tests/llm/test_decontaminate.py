import re

from hypothesis import given, settings
from hypothesis import strategies as st

from geostrata.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"


def patterns(items, window=13):
    """All that counts as an item's text, one pattern for each: whole items, lines and every window of words."""
    found = {}
    for item, text in items:
        words = lambda t: re.findall(r"\w+", t or "")
        whole = words(text)
        parts = [whole] * (len(whole) > 1) + [x for x in map(words, (text or "").split("\n")) if len(x) > 7] + [whole[i : i + window] for i in range(len(whole) - window + 1)]
        for p in parts:
            found.setdefault(f" {' '.join(p).lower()} ", set()).add(item)
    return found


def brute(docs, items):
    """(doc, item) by comparing each pattern with each text, word by word."""
    out = set()
    found = patterns(items)
    for doc, text in docs:
        normal = f" {' '.join(re.findall(r'\w+', text or '')).lower()} "
        out |= {(doc, i) for p, owners in found.items() if p in normal for i in owners}
    return out


def covered(text, items):
    """{item: positions of the text's words that a pattern covers}, pattern by pattern."""
    words = [w.lower() for w in re.findall(r"\w+", text)]
    out = {}
    for p, owners in patterns(items).items():
        p = p.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                for o in owners:
                    out.setdefault(o, set()).update(range(i, i + len(p)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40).map(" ".join) | st.lists(st.sampled_from("abcd\n"), max_size=60).map(" ".join), min_size=1, max_size=3), st.lists(st.integers(0, 200), max_size=6), st.lists(st.sampled_from("abcd"), max_size=30))
def test_spans_against_every_pattern(items, cuts, noise):
    """Texts made of parts of the items, with words that repeat so that runs overlap in many ways."""
    items = list(enumerate(items))
    every = [w for _, t in items for w in t.split()]
    text = " ".join(w for c in cuts for w in [*every[c % (len(every) + 1) :][:17], *noise[: c % 5]])
    got = {}
    for item, a, b, n in decontaminate.Benchmark(items).matches(text):
        first = len(text[:a].split())
        assert len(text[a:b].split()) == n
        got.setdefault(item, set()).update(range(first, first + n))
    assert got == covered(text, items)


def test_nodes_are_bounded_by_the_characters():
    items = [(i, " ".join(f"w{(i * 7919 + k * k) % 5003}" for k in range(300))) for i in range(60)]
    assert decontaminate.Benchmark(items).nodes < 1.3 * sum(len(t) for _, t in items)


def test_documents(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [(r.item_id, r.text) for r in bench.collect()])
    got = queries.op4_decontaminate(spark, SF).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want
    texts = dict(rows)
    for r in got:  # offsets are those of the original text
        assert len(decontaminate.words(texts[r.doc_id][r.span_start : r.span_end])) == r.n_words
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in want}


def test_spans():
    item = "Alpha beta gamma delta epsilon zeta eta theta iota"
    a = decontaminate.Benchmark([(1, item)])
    text = "Foo! ALPHA,  beta\ngamma -- delta; epsilon (zeta) eta. Theta IOTA... bar " * 2
    spans = a.matches(text)
    assert [text[s:e] for _, s, e, _ in spans] == ["ALPHA,  beta\ngamma -- delta; epsilon (zeta) eta. Theta IOTA"] * 2
    assert a.matches("xalpha " + item[6:]) == [] and a.matches(None) == [] and a.matches("") == []
    # a part of an item of the window's length counts, and letters whose lower case is longer don't shift offsets
    long = " ".join(f"w{i}" for i in range(40))
    b = decontaminate.Benchmark([(1, long)])
    text = "İİİ " + " ".join(f"W{i}" for i in range(10, 25)) + " end"
    assert [text[s:e] for _, s, e, _ in b.matches(text)] == [" ".join(f"W{i}" for i in range(10, 25))]
    assert b.matches(" ".join(f"w{i}" for i in range(12))) == []


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Who wrote it?\nAda Lovelace"), (2, "Two words"), (3, "Paris"), (4, "Capital?\nParis")], "item_id bigint, text string")
    texts = ["So: who wrote it? Ada Lovelace, they say", "who wrote it", "ada lovelace", "in two words", "in two, three words", "in Paris", "capital paris", "xcapital paris", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, texts[r.doc_id][r.span_start : r.span_end]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1, "who wrote it? Ada Lovelace"), (3, 2, "two words"), (6, 4, "capital paris")}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {1, 2, 4, 5, 7, 8}


def test_odd_rows(spark, odd, empty):
    schema = "item_id bigint, text string, id int"
    bench = spark.createDataFrame([(1, None, 1), (None, "the quick brown fox jumps over the lazy dog", 1), (2, "", 1), (3, "The quick brown fox; jumps over the lazy dog!", 1), (4, "the quick brown fox jumps over the lazy dog", 1), (5, "one", 1)], schema)
    got = decontaminate.contaminated(odd, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == sorted((d, i) for d in (0, 5, 5, 6, 9) for i in (3, 4))
    out = decontaminate.clean(odd, bench)
    assert out.schema == odd.schema and out.count() == odd.count() - 5
    none = spark.createDataFrame([], schema)
    assert decontaminate.contaminated(odd, none).count() == 0 and decontaminate.clean(odd, none).count() == odd.count()
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.clean(empty, bench).count() == 0


def test_several_automata(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(i, f"number {i} " + "the quick brown fox jumps over the lazy dog" * (i == 3) + " and more words to fill it up a bit") for i in range(8)], "item_id bigint, text string")
    want = sorted(map(str, decontaminate.contaminated(odd, bench).collect()))
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", 100)
    assert sorted(map(str, decontaminate.contaminated(odd, bench).collect())) == want
