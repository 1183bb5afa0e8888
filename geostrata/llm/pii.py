"""Personal data: a semi-Markov conditional random field over candidate segments."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "phone", "ip", "card", "ssn")
LABELS = ("O", *KINDS)
_EACH = np.arange(len(LABELS))
#: Tokens of an entity at most: the bound of the dynamic programme.
MAX_TOKENS = 16
#: Scores of candidates that a task keeps.
CACHE = 100_000
#: Every entity holds one of these characters; texts without them don't leave the JVM.
TRIGGER = "[0-9@]"

_WORD = r"[^\s0-9@]*+[0-9@]\S*+"  # a word with a trigger; it begins at a border only, so no stretch is tried twice
_REGION = re.compile(rf"(?<!\S){_WORD}(?:[ \t ]{_WORD})*")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_LAST_WORD = re.compile(r"([^\W\d_]+)\W*$")
_RUNS = re.compile(r"\d+|[^\W\d_]+|\s+")
_EMAIL = re.compile(r"[A-Za-z0-9](?:[\w.+-]*\w)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
SCHEMA = "doc_id bigint, kind string, span_start int, span_end int"


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of words with a trigger character. All entities lie in one, so each can be decoded on its own."""
    return [m.span() for m in _REGION.finditer(text)]


def _class(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "alnum" if c.isalnum() else c if c in ".@-_/:\"'+(," else "sign"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _whole(s: str, loose: str) -> list[str]:
    """Features of a candidate's form as a whole."""
    out = []
    if "@" in s:
        out.append("is email" if _EMAIL.fullmatch(s) else "no email")
    if loose == "d.d.d.d":
        out.append("octets" if all(int(x) < 256 for x in s.split(".") if len(x) < 10) and max(map(len, s.split("."))) < 4 else "no octets")
    digits = re.sub(r"[^0-9]", "", s)
    if len(digits) >= 13 and loose.replace("_", "").replace("-", "").replace("d", "") == "":
        out.append(f"long number {12 < len(digits) < 20}")
        out.append(f"luhn {_luhn(digits)}")
    return out


def span_features(text: str, a: int, b: int) -> tuple[str, ...]:
    """Features of the whole candidate text[a:b] and of what stands around it."""
    s = text[a:b]
    digits = re.sub(r"[^0-9]", "", s)
    exact = _RUNS.sub(lambda m: f"d{min(len(m[0]), 20)}" if m[0][0].isdigit() else "_" if m[0].isspace() else "a", s)
    loose = re.sub(r"d\d+", "d", exact)
    before, after = text[a - 1 : a], text[b : b + 1]
    beyond = text[b : b + 2]
    more = len(beyond) == 2 and beyond[0] in ".-@_:/" and beyond[1].isalnum()
    less = a > 1 and before in ".-@_:/+(" and text[a - 2].isalnum()
    word = _LAST_WORD.search(text, max(0, a - 30), a)
    out = [
        "shape=" + exact[:40],
        "loose=" + loose[:40],
        f"digits={min(len(digits), 24)}",
        "before=" + _class(before),
        "after=" + _class(after),
        f"first={_class(s[0]) if not s[0].isdigit() else 'digit'}",
        f"last={_class(s[-1]) if not s[-1].isdigit() else 'digit'}",
        f"signs={'' if s.isdigit() else ''.join(sorted({c for c in s if not c.isalnum()}))[:8]}",
        "all",
    ]
    if word:
        out.append("word=" + word[1].lower()[:16])
    if more:
        out.append("goes on")
    if less:
        out.append("began before")
    return (*out, *_whole(s, loose))


class Tokens:
    """Tokens of a region, with what the features of all candidates that begin or end with a token have in common."""

    def __init__(self, text: str, a: int, b: int):
        self.text, self.spans = text, [m.span() for m in _TOKEN.finditer(text, a, b)]
        self._begins: dict[int, tuple] = {}

    def begin(self, i: int) -> tuple:
        """Of token i: trigger, shape, loose shape, ASCII digits, signs with the white space after it, and features."""
        got = self._begins.get(i)
        if got is None:
            text, (a, b) = self.text, self.spans[i]
            s = text[a:b]
            shape = f"d{min(b - a, 20)}" if s[0].isdigit() else "a" if s[0].isalpha() or s[0].isalnum() else s
            gap = text[b : self.spans[i + 1][0]] if i + 1 < len(self.spans) else ""
            before = text[a - 1 : a]
            word = _LAST_WORD.search(text, max(0, a - 30), a)
            less = a > 1 and before in ".-@_:/+(" and text[a - 2].isalnum()
            first = f"first={_class(s[0]) if not s[0].isdigit() else 'digit'}"
            self._begins.pop(i - 2 * MAX_TOKENS, None)
            got = self._begins[i] = (
                s[0].isdigit() or s[0] == "@", shape, "d" if s[0].isdigit() else shape, sum(c in "0123456789" for c in s), frozenset(c for c in s if not c.isalnum()), "_" if gap else "", frozenset(gap),
                "before=" + _class(before), first, *((f"word={word[1].lower()[:16]}",) if word else ()), *(("began before",) if less else ()),
            )
        return got

    def candidates(self, j: int) -> list[tuple[int, tuple[str, ...]]]:
        """Candidates (begin, features) of at most MAX_TOKENS tokens that end with token j and hold a trigger. The features
        are those of `span_features`; what belongs to a span is put together from its tokens, from right to left."""
        text, b = self.text, self.spans[j][1]
        beyond = text[b : b + 2]
        more = len(beyond) == 2 and beyond[0] in ".-@_:/" and beyond[1].isalnum()
        ends = ("after=" + _class(beyond[:1]), f"last={_class(text[b - 1]) if not text[b - 1].isdigit() else 'digit'}")
        cands, has, shape, loose, digits, found, signs = [], False, "", "", 0, frozenset(), ""
        for i in range(j, max(-1, j - MAX_TOKENS), -1):
            trigger, own, bare, n, marks, gap, blank, before, first, *rest = self.begin(i)
            has |= trigger
            if i == j:
                gap, blank = "", frozenset()
            shape, loose, digits = own + gap + shape, bare + gap + loose, digits + n
            if not (marks <= found and blank <= found):
                found = found | marks | blank
                signs = "".join(sorted(found))[:8]
            if not has:
                continue
            out = ["shape=" + shape[:40], "loose=" + loose[:40], f"digits={min(digits, 24)}", before, ends[0], first, ends[1], "signs=" + signs, "all"]
            if rest and rest[0] != "began before":
                out.append(rest[0])
            if more:
                out.append("goes on")
            if rest and rest[-1] == "began before":
                out.append("began before")
            if "@" in found or digits >= 13 or loose == "d.d.d.d":
                out += _whole(text[self.spans[i][0] : b], loose)
            cands.append((i, tuple(out)))
        return cands


def lattice(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[list[tuple[int, tuple[str, ...]]]]]:
    """Tokens of a region and, for each end, its candidates."""
    tokens = Tokens(text, a, b)
    return tokens.spans, [tokens.candidates(j) for j in range(len(tokens.spans))]


def _outside(text: str, span: tuple[int, int]) -> tuple[str, ...]:
    s = text[span[0] : span[1]]
    return ("token=" + (f"d{min(len(s), 20)}" if s[0].isdigit() else "a" if s[0].isalpha() else s), "outside")


class SemiMarkov:
    """Weights: one vector over the labels for each feature; label-to-label transitions of adjacent segments."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, trans: np.ndarray | None = None):
        self.weights: dict[str, np.ndarray] = {} if weights is None else weights
        self.trans = np.zeros((len(LABELS), len(LABELS))) if trans is None else trans
        self._known: dict[tuple[str, ...], np.ndarray] = {}

    def entity(self, features: tuple[str, ...]) -> np.ndarray:
        """The scores of a candidate, of which O is none; kept, as most candidates look like others. For fixed weights."""
        s = self._known.get(features)
        if s is None:
            if len(self._known) > CACHE:
                self._known.clear()
            s = self.score(features)
            s[0] = -np.inf
            self._known[features] = s
        return s

    def score(self, features: tuple[str, ...]) -> np.ndarray:
        out = np.zeros(len(LABELS))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                out += w
        return out

    def segments(self, text: str, token: tuple[int, int], j: int, cands: list) -> list[tuple[int, np.ndarray, tuple[str, ...]]]:
        """Of the segments that end with token j: (begin, scores of the labels, features). Outside of entities a segment is
        one token, with the features of its class."""
        segs = []
        for i, features in cands:
            s = self.score(features)
            s[0] = -np.inf
            segs.append((i, s, features))
        o = np.full(len(LABELS), -np.inf)
        features = _outside(text, token)
        o[0] = self.score(features)[0]
        segs.append((j, o, features))
        return segs

    def decode(self, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
        """The best segmentation of a region (Viterbi): its entities as (kind, start, end).

        Candidates are made when their end is reached and dropped after it; of each token only the way back stays.
        """
        tokens = Tokens(text, a, b)
        spans = tokens.spans
        if not spans:
            return []
        # of each token that a segment may begin with: the best way to it for each label of the segment, and its last label
        ways = {0: (self.trans[0], np.zeros(len(LABELS), np.int64))}
        back: list[list] = [[]]
        for j, span in enumerate(spans):
            cands = tokens.candidates(j)
            outside = self._known.get(key := _outside(text, span))
            if outside is None:
                outside = np.full(len(LABELS), -np.inf)
                outside[0] = self.score(key)[0]
                self._known[key] = outside
            begins = [*(i for i, _ in cands), j]
            total = np.stack([ways[i][0] for i in begins]) + np.stack([*(self.entity(f) for _, f in cands), outside])
            arg = total.argmax(axis=0)
            top = total[arg, _EACH]
            back.append([(begins[k], int(ways[begins[k]][1][y])) for y, k in enumerate(arg.tolist())])
            via = top[:, None] + self.trans
            last = via.argmax(axis=0)
            ways[j + 1] = via[last, _EACH], last
            ways.pop(j - MAX_TOKENS, None)
        j, y, out = len(spans), int(top.argmax()), []
        while j:
            i, before = back[j][y]
            if y:
                out.append((LABELS[y], spans[i][0], spans[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def gradient(self, text: str, tokens: list, ends: list, gold: list[tuple[int, int, int]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Observed less expected feature counts: the gradient of the conditional log-likelihood (forward-backward)."""
        n = len(tokens)
        segs = [self.segments(text, tokens[j], j, ends[j]) for j in range(n)]
        alpha = np.full((n + 1, len(LABELS)), -np.inf)
        beta = np.full((n + 1, len(LABELS)), -np.inf)
        alpha[0, 0], beta[n] = 0, 0
        lse = lambda m: (t := m.max(axis=0)) + np.log(np.exp(m - np.where(np.isfinite(t), t, 0)).sum(axis=0))
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(n):
                alpha[j + 1] = lse(np.stack([lse(alpha[i][:, None] + self.trans) + s for i, s, _ in segs[j]]))
            for j in range(n - 1, -1, -1):
                for i, s, _ in segs[j]:
                    into = lse((self.trans + (s + beta[j + 1])[None, :]).T)
                    beta[i] = np.logaddexp(beta[i], into)
            z = lse(alpha[n] + beta[n])
            marks = {(i, j): y for i, j, y in gold}
            grad: dict[str, np.ndarray] = {}
            trans = np.zeros_like(self.trans)
            for j in range(n):
                for i, s, features in segs[j]:
                    p = np.exp(alpha[i][:, None] + self.trans + (s + beta[j + 1])[None, :] - z)
                    trans -= p
                    d = -p.sum(axis=0)
                    if features[-1] == "outside":
                        d[0] += (i, j) not in marks and not any(a <= j <= b for a, b in marks)
                    elif (i, j) in marks:
                        d[marks[i, j]] += 1
                    if np.abs(d).max() > 1e-4:
                        for f in features:
                            g = grad.get(f)
                            grad[f] = d.copy() if g is None else g + d
        labels, j = [0], 0
        by_begin = {i: (b, y) for (i, b), y in marks.items()}
        while j < n:
            b, y = by_begin.get(j, (j, 0))
            labels.append(y)
            j = b + 1
        for x, y in zip(labels, labels[1:]):
            trans[x, y] += 1
        return grad, trans


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Synthetic training sentences with their entities; all values are invented."""
    rng = random.Random(seed)
    syllables = "an er the ing ou st tion ver ge lich que ment ción os la de ra to mi sch é ea re".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    num = lambda k: "".join(rng.choices("0123456789", k=k))

    def email() -> str:
        local = rng.choice(["{w}.{n}", "{w}{n}", "{w}", "{w}.{w2}", "{w}_{w2}", "{w}+{w2}", "{w}-{n}"])
        clean = lambda: re.sub("[^a-z]", "a", word())
        local = local.format(w=clean(), w2=clean(), n=rng.randint(0, 999))
        return f"{local}@{rng.choice(['mail', 'post', clean()])}{rng.choice(['', str(rng.randint(1, 9))])}.{rng.choice(['example.com', 'example.org', 'co.uk', 'net', 'de', 'example.net'])}"

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        cc = rng.choice(["1", "44", "49", "33", "34"])
        return rng.choice([f"+{cc} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"{a}-{b}-{c}", f"+{cc}-{a}-{b}-{c}", f"+{cc}{a}{b}{c}", f"{a}.{b}.{c}", f"+{cc} {num(2)} {num(4)} {num(4)}"])

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        d = num(rng.choice([16, 16, 16, 15, 14, 13, 19]))
        if rng.random() < 0.4:
            d = next(x for k in range(10) if _luhn(x := d[:-1] + str(k)))
        return d if len(d) != 16 or rng.random() < 0.6 else rng.choice("- ").join(d[k : k + 4] for k in range(0, 16, 4))

    def ssn() -> str:
        return f"{num(3)}-{num(2)}-{num(4)}"

    def other() -> str:
        big = rng.choice([20, 21, 24, 32])
        return rng.choice(
            [
                lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}", lambda: f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 30)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}",
                lambda: num(rng.randint(1, 9)), lambda: f"{rng.randint(1, 99)},{num(3)}.{num(2)}", lambda: f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}"', lambda: f"{num(3)}.{num(1)}%", lambda: f"ISBN {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
                lambda: f"@{word()}", lambda: f"{word()}{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}.{num(4)}", lambda: num(big), lambda: f"build {num(1)}.{num(1)}.{num(5)}.{num(1)}", lambda: f"({num(4)})", lambda: f"{num(1)}.", lambda: f"CC BY-NC {num(1)}.0",
                lambda: f"{''.join(rng.choices('0123456789abcdef', k=8))}-{num(4)}-4{num(3)}-a{num(3)}-{''.join(rng.choices('0123456789abcdef', k=12))}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{rng.randint(300, 999)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"$ {num(3)} x {num(2)}", lambda: f"{word()} @ {num(2)}", lambda: f"0x{num(8)}",
            ]
        )()

    make = {"email": email, "phone": phone, "ip": ip, "card": card, "ssn": ssn}
    out = []
    for _ in range(n):
        text, marks = "", []
        for _ in range(rng.randint(2, 4)):
            text += " ".join(word() for _ in range(rng.randint(0, 2))) + " "
            wrap = rng.choice(["{}", "{}", "{}", "({})", '"{}"', "<{}>", "{},", "{}.", "{}!!", "{}%%%", "{}***", "{}###", "{}$$$", "{}&&&", "{}:", "| {} |"])
            kind = rng.choice([*KINDS, "O", "O", "O", "O"])
            value = other() if kind == "O" else make[kind]()
            if rng.random() < 0.15:
                value = value.upper()
            if kind == "O" and rng.random() < 0.5:
                wrap = "{}"
            at = len(text) + wrap.index("{")
            if kind != "O":
                marks.append((kind, at, at + len(value)))
            text += wrap.replace("{}", value) + rng.choice([" ", " ", "\n"])
        out.append((text, marks))
    return out


@lru_cache(maxsize=1)
def trained(sentences: int = 300, epochs: int = 3, seed: int = 11) -> SemiMarkov:
    """The model fitted on invented sentences (AdaGrad on the conditional log-likelihood); deterministic."""
    model = SemiMarkov()
    rows = []
    for text, marks in examples(sentences, seed):
        for a, b in regions(text):
            tokens, ends = lattice(text, a, b)
            begins, finishes = {x: i for i, (x, _) in enumerate(tokens)}, {y: i for i, (_, y) in enumerate(tokens)}
            gold = [(begins[x], finishes[y], LABELS.index(k)) for k, x, y in marks if x in begins and y in finishes]
            if tokens:
                rows.append((text, tokens, ends, gold))
    seen: dict[str, np.ndarray] = {}
    total = np.full_like(model.trans, 1e-6)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(rows)
        for text, tokens, ends, gold in rows:
            grad, trans = model.gradient(text, tokens, ends, gold)
            for f, g in grad.items():
                s = seen[f] = seen.get(f, 1e-6) + g * g
                model.weights[f] = model.weights.get(f, 0) + 0.3 * g / np.sqrt(s)
            total += trans * trans
            model.trans += 0.1 * trans / np.sqrt(total)
    return model


def find(text: str | None, model: SemiMarkov) -> list[tuple[str, int, int]]:
    return [e for a, b in regions(text or "") for e in model.decode(text, a, b)]


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each entity: doc_id, kind and its span in the original text.

    Whole texts are read; between regions with digits or @ nothing can be an entity, so each region is decoded on its
    own and the result is that of one pass over the text. Null and empty texts give no row, an empty table an empty
    result. Repeated rows are each answered; a null id stays null; other columns are ignored.
    """
    cols = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(TRIGGER))
    model = trained()
    share = docs.sparkSession.sparkContext.broadcast((model.weights, model.trans))

    def make():
        model = SemiMarkov(*share.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids = batch["id"].to_pylist()
            rows = [(ids[i], *m) for i, t in enumerate(batch["text"].to_pylist()) for m in find(t, model)]
            if not rows:
                return None
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "kind", "span_start", "span_end"])

        return each

    return map_batches(cols, SCHEMA, make)
