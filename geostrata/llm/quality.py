"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches

#: Labelled documents that the machine is fitted on at most (those with the smallest hash of their id).
MAX_TRAIN = 16_000
#: Hash buckets of words. Those that occur in MIN_DOCS training documents and whose chi-square statistic against the
#: class reaches MIN_CHI2 (p = 6e-5, for tens of thousands of words looked at) get weights; the rest is noise to fit on.
BUCKETS = 1 << 30
MIN_DOCS = 5
MIN_CHI2 = 16.0
RANK = 8
EPOCHS = 8
THRESHOLD = 0.5
#: Bytes of text whose words are numbered together.
SLICE = 8_000_000
#: Different words of a slice that are hashed together, and words that are put in order together (about; those of one text
#: always are). It bounds the memory that this takes.
STRETCH = 1 << 16
PREFIXES = (4, 5, 6, 7)

_STRIP = string.punctuation + "“”«»„…–—"
_UPPER, _DIGIT, _SPACE, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,"]] = True


def name_bucket(name: str) -> int:
    """The bucket of a statistic's or metadata's feature."""
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def _bin(name: str, value: float, edges: tuple[float, ...]) -> str:
    return f"\0{name}:{sum(value >= e for e in edges)}"


_RATIO = (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)


def structure(text: str, n: int, distinct: int, longest: int, lang: str | None, source: str | None) -> list[str]:
    """The binned statistics of one text of n words, `distinct` of them different and at most `longest` equal ones in a row,
    and its metadata, as feature names (their NUL keeps them apart from words)."""
    h = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, size = max(1, n), max(1, int(h.sum()))
    filled = [x for x in text.split("\n") if x]
    return [
        _bin("upper", h[_UPPER].sum() / size, _RATIO),
        _bin("digit", h[_DIGIT].sum() / size, _RATIO),
        _bin("space", h[_SPACE].sum() / size, _RATIO),
        _bin("symbol", h[_SYMBOL].sum() / size, _RATIO),
        _bin("pipe", h[124] / size, _RATIO),
        _bin("distinct", distinct / n, _RATIO) + f"/{min(4, int(math.log10(n)))}",
        _bin("lines", len(set(filled)) / max(1, len(filled)), _RATIO),
        _bin("run", longest, (2, 3, 5, 8, 15, 30)),
        _bin("words", n, (3, 10, 30, 100, 300, 1000, 3000)),
        _bin("length", (size - h[_SPACE].sum()) / n, (2, 3, 4, 5, 6, 7, 8, 10, 15)),
        _bin("line", n / max(1, len(filled)), (2, 5, 10, 20, 50, 100, 300)),
        f"\0lang:{lang}",
        f"\0source:{source}",
    ]


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its stems (one column each), and which of them there are: prefixes catch inflected forms
    that no training document has. Case and signs at the ends don't count.

    A word's hash is the sum of one for each character at its place, so a running sum has those of all prefixes.
    """
    words = pc.utf8_trim(pc.utf8_lower(words), characters=_STRIP)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    place = (np.arange(len(codes)) - np.repeat(start, size)).astype(np.uint64)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mixed(codes | (place << np.uint64(32))), out=total[1:])
    ends = np.stack([size, *(np.minimum(size, k) for k in PREFIXES)], 1)
    salt = np.arange(1 + len(PREFIXES), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = _mixed((total[start[:, None] + ends] - total[start][:, None]) ^ salt)
    there = np.stack([np.ones(len(size), bool), *(size >= k for k in PREFIXES)], 1)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), there


def _cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of things of these sizes, of about `most` together, one thing at least."""
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]
    return list(zip(cuts, cuts[1:]))


class Features:
    """Distinct buckets of documents or, with `buckets` (sorted, those that have weights), the positions in it.

    Words are what white space separates. Arrow splits a slice of the texts and numbers its different words; each of these
    is hashed once, and all of it are array operations. A document has some four features for each of its words, so these
    are made a stretch of documents at a time: a task holds the numbers of a slice's words and the features of a stretch.
    """

    def __init__(self, buckets: np.ndarray | None = None):
        self.buckets = buckets

    def _rows(self, found: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a row of buckets each: values one row after the other, and how many there are in each."""
        if self.buckets is not None:
            at = np.searchsorted(self.buckets, found)
            there = there & (self.buckets[np.minimum(at, len(self.buckets) - 1)] == found) if len(self.buckets) else np.zeros_like(there)
            found = at
        return found[there].astype(np.int32), there.sum(axis=1)

    def _stretch(self, texts: pa.Array, code: np.ndarray, sizes: np.ndarray, empty: int, words: int, known: tuple[np.ndarray, np.ndarray], langs: list, sources: list) -> tuple[np.ndarray, np.ndarray]:
        """Of texts with so many words each, whose numbers follow each other in `code`. There are `words` different ones, with
        the values `known`; that with the number `empty` is none."""
        doc = np.repeat(np.arange(len(texts)), sizes)
        if empty >= 0:  # white space at the ends of a text leaves empty parts
            code, doc = code[code != empty], doc[code != empty]
        count = np.bincount(doc, minlength=len(texts))
        change = np.flatnonzero((code[1:] != code[:-1]) | (doc[1:] != doc[:-1])) + 1
        runs = np.concatenate([[0], change]) if len(code) else change
        longest = np.zeros(len(texts), np.int64)
        np.maximum.at(longest, doc[runs], np.diff(np.append(runs, len(code))))
        owner, word = np.divmod(np.unique(doc * max(1, words) + code), max(1, words))
        distinct = np.bincount(owner, minlength=len(texts))
        flat, size = known
        start, each = np.cumsum(size) - size, size[word]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[word], each)
        names = [structure(*x) for x in zip(texts.to_pylist(), count.tolist(), distinct.tolist(), longest.tolist(), langs, sources)]
        rest = np.array([[name_bucket(x) for x in n] for n in names], np.int64)
        rest, more = self._rows(rest, np.ones(rest.shape, bool))
        owner = np.concatenate([np.repeat(owner, each), np.repeat(np.arange(len(texts)), more)])
        owner, value = np.divmod(np.unique((owner << 31) | np.concatenate([flat[at], rest])), 1 << 31)
        return value.astype(np.int32), np.bincount(owner, minlength=len(texts))

    def _slice(self, texts: pa.Array, langs: list, sources: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lists = pc.utf8_split_whitespace(texts)
        sizes, coded = lists.value_lengths().to_numpy(), lists.flatten().dictionary_encode()
        del lists
        code, vocabulary = coded.indices.to_numpy(), coded.dictionary
        parts = [self._rows(*word_buckets(vocabulary.slice(a, STRETCH))) for a in range(0, max(1, len(vocabulary)), STRETCH)]
        empty, known = pc.index(vocabulary, "").as_py(), tuple(np.concatenate(x) for x in zip(*parts))
        at = np.concatenate([[0], np.cumsum(sizes)])
        for a, b in _cuts(sizes, STRETCH):
            yield self._stretch(texts.slice(a, b - a), code[at[a] : at[b]].astype(np.int64), sizes[a:b], empty, len(vocabulary), known, langs[a:b], sources[a:b])

    def of(self, texts: pa.Array, langs: pa.Array, sources: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The documents' values, sorted in each, one document after the other, and how many each has. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        langs, sources = langs.to_pylist(), sources.to_pylist()
        cuts = _cuts(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE)
        parts = [x for a, b in cuts for x in self._slice(texts.slice(a, b - a), langs[a:b], sources[a:b])]
        return np.concatenate([v for v, _ in parts]), np.concatenate([n for _, n in parts])


class Machine:
    """p(good | x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) with x_i in {0, 1}.

    The pair sum is half of sum_f ((sum_i v_if)^2 - sum_i v_if^2), so a score is linear in the number of features.
    """

    def __init__(self, buckets: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.buckets, self.w0, self.w, self.v = buckets, w0, w, v
        self.table = np.concatenate([w[:, None], v, (v * v).sum(axis=1, keepdims=True)], axis=1)

    def scores(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of documents whose features, as rows of the weights, follow each other in `index`."""
        rows = np.concatenate([self.table[index], np.zeros((1, self.table.shape[1]), self.table.dtype)]).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        sums = np.add.reduceat(rows, np.minimum(starts, len(index)), axis=0)
        sums[sizes == 0] = 0
        return self.w0 + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(axis=1) - sums[:, -1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def informative(feats: DataFrame, min_docs: int = MIN_DOCS, min_chi2: float = MIN_CHI2) -> np.ndarray:
    """Sorted buckets that occur in enough documents and unevenly enough in the two classes, of rows (good, x).

    They are counted on the executors; only those that are chosen reach the driver.
    """
    n, good = feats.agg(F.count("*"), F.sum("good")).first()
    rate = (good or 0) / max(1, n)
    if not 0 < rate < 1:
        return np.zeros(0, np.int32)
    docs, hits = F.col("docs"), F.col("hits")
    counts = feats.select("good", F.explode("x").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("good").alias("hits"))
    chi2 = F.pow(hits - docs * rate, F.lit(2)) / (docs * rate * (1 - rate)) * n / (n - docs)
    chosen = counts.where((docs >= min_docs) & (docs < n)).where(chi2 >= min_chi2).select("bucket").toArrow()
    return np.sort(chosen["bucket"].to_numpy())


def train(buckets: np.ndarray, rows: list[np.ndarray], good: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad on mini-batches; deterministic. `rows` holds positions in `buckets`. Without both classes
    among the rows the machine keeps everything, or nothing if there are bad ones only."""
    if not len(good) or good.min() == good.max():
        return Machine(np.zeros(0, np.int64), 0.0 if not len(good) or good.max() > 0 else -30.0, np.zeros(0), np.zeros((0, rank)))
    rng = np.random.default_rng(seed)
    m = len(buckets)
    w0, w, v = float(np.log(good.mean() / (1 - good.mean()))), np.zeros(m), rng.normal(0, 0.01, (m, rank))
    g0, gw, gv, rate, decay = 1e-8, np.full(m, 1e-8), np.full((m, rank), 1e-8), 0.1, 2e-5
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 64):
            batch = order[a : a + 64]
            sizes = np.array([len(rows[i]) for i in batch])
            index = np.concatenate([rows[i] for i in batch])
            if not len(index):
                continue
            owner = np.repeat(np.arange(len(batch)), sizes)
            vx = v[index]
            s = np.zeros((len(batch), rank))
            np.add.at(s, owner, vx)
            z = w0 + np.bincount(owner, w[index], len(batch)) + 0.5 * ((s**2).sum(1) - np.bincount(owner, (vx**2).sum(1), len(batch)))
            e = sigmoid(z) - good[batch]
            g0 += (d := e.sum()) ** 2
            w0 -= rate * d / math.sqrt(g0)
            used, at = np.unique(index, return_inverse=True)
            dw = np.bincount(at, e[owner], len(used)) + decay * w[used]
            dv = np.stack([np.bincount(at, e[owner] * (s[owner, f] - vx[:, f]), len(used)) for f in range(rank)], 1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
    return Machine(buckets, w0, w, v)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    extra = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *extra)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Machine:
    """Good means quality 1 and not toxic. A document with several labels is good if all say so; null labels don't
    count, a null `toxic` is 0. Of equal texts one is used (the lowest id), so that copies don't outweigh the rest."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(max_train)
    sample = _columns(docs, id_col, text_col).join(F.broadcast(marks), "id")

    def make():
        features = Features()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            value, size = features.of(batch["text"], batch["lang"], batch["source"])
            raw = ((t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch["text"])  # one at a time
            digest, length = zip(*((xxhash.xxh3_64_intdigest(t) - (1 << 63), len(t)) for t in raw))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(value, pa.int32()))
            return pa.RecordBatch.from_arrays([batch["id"], batch["good"], pa.array(digest, pa.int64()), pa.array(length, pa.int64()), lists], names=["id", "good", "digest", "length", "x"])

        return each

    feats = map_batches(sample.select("id", "good", "text", "lang", "source"), "id bigint, good int, digest bigint, length bigint, x array<int>", make)
    feats = checkpointed(feats.withColumn("row", F.monotonically_increasing_id()))
    firsts = feats.groupBy("digest", "length").agg(F.min(F.struct("id", "row")).alias("r")).select("r.row")  # no more than max_train
    feats = feats.join(F.broadcast(firsts), "row", "left_semi").select("id", "good", "x")
    buckets = informative(feats)

    def select():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch["x"]
            flat, sizes = x.flatten().to_numpy(), x.value_lengths().to_numpy()
            at = np.searchsorted(buckets, flat)
            use = (at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == flat) if len(buckets) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(use)])[np.concatenate([[0], np.cumsum(sizes)])]
            return pa.RecordBatch.from_arrays([batch["id"], batch["good"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[use], pa.int32()))], names=["id", "good", "x"])

        return each

    got = map_batches(feats, "id bigint, good int, x array<int>", select).toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    lists = got["x"].to_pylist()
    return train(buckets, [np.array(lists[i], np.int64) for i in order], got["good"].to_numpy()[order].astype(float))


def classify(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, p_good and keep (p_good >= threshold).

    Whole texts count. Null and empty texts are scored by their metadata and statistics alone; null `lang` or `source`,
    or a table without these columns, count as a value of its own. Repeated rows get equal scores. With `carry` all
    columns of `docs` come back as they are, of the rows to keep only; a column that is named like one of the
    helper columns doesn't clash, as those start with `__fm_`.
    """
    share = docs.sparkSession.sparkContext.broadcast((machine.buckets, machine.w0, machine.w, machine.v))

    def make():
        machine = Machine(*share.value)
        features = Features(machine.buckets)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            value, size = features.of(*(batch.column(i) for i in read))
            cuts = np.concatenate([np.arange(0, len(size), 500), [len(size)]])
            at = np.concatenate([[0], np.cumsum(size)])[cuts]
            p = sigmoid(np.concatenate([machine.scores(value[x:y], size[a:b]) for a, b, x, y in zip(cuts, cuts[1:], at, at[1:])]))
            if carry:
                return batch.select(list(range(width))).filter(pa.array(p >= threshold))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "p_good", "keep"])

        return each

    if not carry:
        read, parts = [1, 2, 3], _columns(docs, id_col, text_col)
        return map_batches(parts.select("id", "text", "lang", "source"), "doc_id bigint, p_good double, keep boolean", make)
    width, read, extra = len(docs.columns), [], []
    for c in (text_col, "lang", "source"):
        if dict(docs.dtypes).get(c) == "string":  # as it is: texts that go to Python twice take twice the memory
            read.append(docs.columns.index(c))
        else:
            read.append(width + len(extra))
            extra.append((F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(f"__fm_{c}"))
    return map_batches(docs.select("*", *extra), docs.schema, make)


def quality(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Fits on the labelled rows (bounded by MAX_TRAIN) and answers all rows; see `classify`."""
    return classify(docs, fit(docs, labels), **kw)
