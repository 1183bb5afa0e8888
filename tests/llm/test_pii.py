import re
import time
import tracemalloc
from functools import lru_cache

import numpy as np

from geostrata.llm import pii, queries
from tests.compare import SMALL

MODEL = pii.trained()


def test_held_out_sentences():
    hit = found = true = 0
    for text, marks in pii.examples(300, seed=99):
        got = set(pii.find(text, MODEL))
        hit += len(got & set(marks))
        found += len(got)
        true += len(marks)
    assert hit / found > 0.93 and hit / true > 0.93


def test_decoding_is_the_best_of_all_segmentations():
    def all_ways(segs, j):
        if j == 0:
            yield 0.0, 0
            return
        for i, s, _ in segs[j - 1]:
            for total, before in all_ways(segs, i):
                for y in np.flatnonzero(np.isfinite(s)):
                    yield total + MODEL.trans[before, y] + s[y], int(y)

    for text in ("a.1@b2.de x", "10.0.0.1", "+1 (22) 3", "@7-8"):
        for a, b in pii.regions(text):
            tokens, ends = pii.lattice(text, a, b)
            segs = [MODEL.segments(text, tokens[j], j, ends[j]) for j in range(len(tokens))]
            best = max(x for x, _ in all_ways(segs, len(tokens)))
            score, before, j = 0.0, 0, 0
            marks = {s: (e, k) for k, s, e in MODEL.decode(text, a, b)}
            while j < len(tokens):
                end, y = j, 0
                if tokens[j][0] in marks:
                    stop, kind = marks[tokens[j][0]]
                    end, y = next(k for k in range(j, len(tokens)) if tokens[k][1] == stop), pii.LABELS.index(kind)
                s = next(s for i, s, _ in segs[end] if i == j and np.isfinite(s[y]))
                score, before, j = score + MODEL.trans[before, y] + s[y], y, end + 1
            assert abs(score - best) < 1e-9


def test_features_of_a_candidate_are_those_of_its_span():
    texts = [t for t, _ in pii.examples(60, seed=5)] + ["a² 1_2  x@y.de\xa03", "ſ1 ٣4 _7_\t8 é9", "1.2.3.4 4532015112830366 4532-0151-1283-0366"]
    for text in texts:
        for a, b in pii.regions(text):
            tokens, ends = pii.lattice(text, a, b)
            for j, cands in enumerate(ends):
                begins = [i for i in range(j, max(-1, j - pii.MAX_TOKENS), -1) if any(text[tokens[k][0]].isdigit() or text[tokens[k][0]] == "@" for k in range(i, j + 1))]
                assert [(i, f) for i, f in cands] == [(i, pii.span_features(text, tokens[i][0], tokens[j][1])) for i in begins]


def test_found_and_left_alone():
    text = "Write to jane.doe@mail3.example.com, call +1 (482) 555-7163 or 192.168.10.77; card 4532015112830366."
    assert [(k, text[a:b]) for k, a, b in pii.find(text, MODEL)] == [("email", "jane.doe@mail3.example.com"), ("phone", "+1 (482) 555-7163"), ("ip", "192.168.10.77"), ("card", "4532015112830366")]
    for plain in ("version 1.2", "on 2024-01-05 at 10:20:30", "it costs 1,200.50", "no digits here", "", None, "CC BY-NC 4.0"):
        assert pii.find(plain, MODEL) == []


def slow(text):
    """Words with a trigger joined by one blank, then the semi-Markov recursion in plain Python from the right."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text) if re.search("[0-9@]", m.group())]
    areas = []
    for a, b in words:
        if areas and a == areas[-1][1] + 1 and text[areas[-1][1]] in " \t\xa0":
            areas[-1][1] = b
        else:
            areas.append([a, b])
    out = []
    for a, b in areas:
        tokens = [m.span() for m in re.finditer(r"[^\W\d_]+|\d+|[^\w\s]|_", text[a:b])]
        tokens = [(x + a, y + a) for x, y in tokens]
        n, best = len(tokens), {}
        for i in range(n, -1, -1):
            for before in range(len(pii.LABELS)):
                if i == n:
                    best[i, before] = (0.0, None)
                    continue
                ways = [(MODEL.trans[before, 0] + MODEL.score(pii._outside(text, tokens[i]))[0] + best[i + 1, 0][0], (i + 1, 0))]
                for j in range(i + 1, min(n, i + pii.MAX_TOKENS) + 1):
                    span = text[tokens[i][0] : tokens[j - 1][1]]
                    if any(c.isdigit() or c == "@" for c in span):
                        scores = scored(text, tokens[i][0], tokens[j - 1][1])
                        ways += [(MODEL.trans[before, y] + scores[y] + best[j, y][0], (j, y)) for y in range(1, len(pii.LABELS))]
                best[i, before] = max(ways)
        i = y = 0
        while i < n:
            j, kind = best[i, y][1]
            if kind:
                out.append((pii.LABELS[kind], tokens[i][0], tokens[j - 1][1]))
            i, y = j, kind
    return out


@lru_cache(maxsize=None)
def scored(text, a, b):
    return MODEL.score(pii.span_features(text, a, b)).tolist()


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = sorted((i, *e) for i, t in rows for e in slow(t or ""))
    assert sorted(map(tuple, queries.op9_pii(spark, SMALL).collect())) == want and len(want) > 10


def test_regions_are_found_in_linear_time():
    for text in ("漢" * 400_000 + " 1", "9 " * 3 + "x" * 400_000, "data:" + "A" * 400_000 + " a@b.de"):
        began = time.process_time()
        assert len(pii.regions(text)) == 1
        assert time.process_time() - began < 1


def test_memory_does_not_grow_with_a_region():
    """A table of numbers is one region; its candidates are not held together."""
    text = " ".join(str(1000 + i) for i in range(4_000))
    tracemalloc.start()
    pii.find(text, MODEL)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15_000_000


def test_odd_rows(spark, odd, empty):
    more = odd.selectExpr("doc_id", "concat(text, '\\nme@mail.example.com\\n') text", "id", "row", "keep")
    got = pii.pii(more).where("kind = 'email'").collect()
    assert len(got) == odd.where("text is not null").count() and {r.doc_id for r in got} >= {None, 2, 4, 5}
    assert pii.pii(empty).count() == 0
