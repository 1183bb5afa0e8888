"""Secret scan: sliding-window Shannon entropy by character class over candidate strings."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Shortest candidate, and what the JVM looks for before a text is sent to Python (the same strings).
MIN_LENGTH = 20
CANDIDATE = r"[A-Za-z0-9+/_\-]{20,}={0,2}"  # a sign of equality within parts a name from its value


@dataclass(frozen=True)
class CharClass:
    """A class of strings: its alphabet, the width of the window and the entropy in bits that one window must reach."""

    name: str
    alphabet: frozenset
    window: int
    bits: float


_HEX = frozenset("0123456789abcdefABCDEF")
_ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: In order: a candidate belongs to the first class that holds all its characters.
CLASSES = (
    CharClass("hex", _HEX, 20, 2.7),
    CharClass("alphanumeric", _ALNUM, 20, 3.55),
    CharClass("base64", _ALNUM | frozenset("+/=_-"), 20, 3.7),
)
#: Names that give a value away as a secret, where one of them stands shortly before it.
KEYWORD = re.compile(r"(?i)(token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)\W{0,12}$")
#: Prefixes of issued keys. They are evidence of their own, so a window of such a value needs KNOWN_BITS only.
KNOWN = re.compile(r"(?:^|/)(?:A[KS]IA[A-Z2-7]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20}|github_pat_[A-Za-z0-9]{20}|glpat-|xox[abprs]-|[prs]k_(?:live|test)_|(?:sk-|npm_|hf_)[A-Za-z0-9]{20}|AIza[A-Za-z0-9_-]{30})")
KNOWN_BITS = 3.0
#: The password, and the whole or the user, before the @ of a URL: what stands before and after the value.
URL_USER, URL_PASSWORD, URL_HOST = re.compile(r"://[^\s/?#@]*$"), re.compile(r"://[^\s/?#@:]*:[^\s/?#@]*$"), re.compile(r"[^\s/?#@]*@")
PORT = re.compile(r"\d+/")
#: Pairs of letters that make up 92 to 96 % of those within words (counted in documents and in names of programs), but
#: a third of all pairs. Without two digits, a bare candidate is a key if less than WORDLIKE of its pairs are such.
PAIRS = frozenset(
    a + b
    for a, *bs in "aabcdegilmnoprstuv baejlouy caehiklot daeiostu eabcdefghilmnoprstuvwxz faefioru gaeis habehilnorstw iacdefglmnoprstv ke ladefilostuy maeiop nabcdeghilnorstuvw obcdfilmnoprstuw paefloprt qu rabceghilmnorstuy sacehiopstu taehilnorstuyz uaeilmnprstx vaei wahi xct ypst zeu".split()
    for b in bs
)
WORDLIKE = 0.65
#: Contexts and forms that are random but public; numbers (of orders, accounts, measurements) are among the forms.
ALLOW_CONTEXT = re.compile(r"(?i)(?<![a-z])(?:commit|revision|sha-?(?:1|256|512)?|md5|checksum|digest|etag|integrity|base64,|blob|tree)\W{0,6}$|://\S*$")
ALLOW_VALUE = re.compile(r"(?i)^[0-9]+$|example|placeholder|xxxx|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(.{1,4})\1+$|0123456789|abcdefgh")

_RX = re.compile(CANDIDATE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SCHEMA = "doc_id bigint, span_start int, span_end int, char_class string, entropy double, masked string"


def class_of(value: str) -> CharClass:
    chars = set(value)
    return next(c for c in CLASSES if chars <= c.alphabet)


def window_entropy(value: str, window: int) -> float:
    """The largest Shannon entropy (bits a character) of a window of `value`, or of all of it if it is shorter.

    Counts are kept while the window moves: each step changes two counts, so a step costs the same for any width.
    """
    n = min(window, len(value))
    if not n:
        return 0.0
    weight = _weights(n)
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c)
    best = None
    for i, c in enumerate(value):
        k = counts.get(c, 0)
        total += weight[k + 1] - weight[k]
        counts[c] = k + 1
        if i >= n:
            gone = value[i - n]
            k = counts[gone]
            total += weight[k - 1] - weight[k]
            counts[gone] = k - 1
        if i >= n - 1 and (best is None or total < best):
            best = total
    return float(np.log2(n) - best / n)


_WEIGHTS: dict[int, list[float]] = {}


def _weights(n: int) -> list[float]:
    if n not in _WEIGHTS:
        _WEIGHTS[n] = [0.0] + [c * float(np.log2(c)) for c in range(1, n + 2)]
    return _WEIGHTS[n]


def wordlike(value: str) -> float:
    """The share of a value's pairs of neighbouring letters or digits that are in words and common there."""
    pairs = sum(a.isalnum() and b.isalnum() for a, b in zip(value, value[1:]))
    common = sum(w[i : i + 2] in PAIRS for w in map(str.lower, _PARTS.findall(value)) for i in range(len(w) - 1))
    return common / pairs if pairs else 1.0


def looks_mixed(value: str, kind: CharClass) -> bool:
    """Words joined by - or _ and long words are no keys: besides hexadecimal ones, a key mixes letters and digits, or
    its letters don't follow each other as in words."""
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    if kind.name == "hex":
        return digits > 0 and letters > 0
    upper = sum(c.isupper() for c in value)
    return (digits > 1 and letters > 1 and (digits >= len(value) // 12 or 0 < upper < letters)) or (letters > 0 and wordlike(value) < WORDLIKE)


def scan(text: str | None) -> list[tuple[int, int, str, float, str]]:
    """(start, end, class, entropy, masked value) of the secrets of a text, from left to right.

    A name such as `token` shortly before the value, a known prefix and the place of a URL's password override the
    allow-list of contexts, not that of values, and leave the verdict to the entropy. Other values must also look mixed.
    """
    out = []
    for m in _RX.finditer(text or ""):
        value = m.group().strip("-_/") if not m.group().endswith("=") else m.group().lstrip("-_/")
        start = m.start() + m.group().find(value)
        if len(value) < MIN_LENGTH:
            continue
        kind = class_of(value)
        before = text[max(0, start - 40) : start]
        if ALLOW_VALUE.search(value):
            continue
        known = KNOWN.search(value)
        if not known and not KEYWORD.search(before):
            at_host = URL_HOST.match(text, start + len(value))
            password = at_host and URL_PASSWORD.search(before) and not PORT.match(value)
            user = at_host and URL_USER.search(before) and "/" not in value
            if not password and not user and ALLOW_CONTEXT.search(before):
                continue
            if not password and not looks_mixed(value, kind):
                continue
        bits = window_entropy(value, kind.window)
        if bits >= (min(KNOWN_BITS, kind.bits) if known else kind.bits):
            out.append((start, start + len(value), kind.name, round(bits, 6), value[:4] + "*" * (len(value) - 8) + value[-4:]))
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each secret: doc_id, span in the original text, character class, entropy and the masked value.

    Whole texts are scanned. Only texts with a candidate leave the JVM. Null and empty texts and texts without a secret
    give no row, an empty table an empty result. Repeated rows are each answered; a null id stays null; other columns
    are ignored.
    """
    cols = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(CANDIDATE))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids = batch["id"].to_pylist()
            rows = [(ids[i], *m) for i, t in enumerate(batch["text"].to_pylist()) for m in scan(t)]
            if not rows:
                return None
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "span_start", "span_end", "char_class", "entropy", "masked"])

        return each

    return map_batches(cols, SCHEMA, make)
