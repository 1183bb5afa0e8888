"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

ORDERS = (1, 2, 3)
BITS = 16
#: Characters that are scored at once; bounds the working memory of a task. It doesn't show in the scores.
CHUNK = 200_000
#: Labelled documents that the model is fitted on at most (those with the smallest hash of their id).
MAX_TRAIN = 8_000
SMOOTHING = 0.5
UNDETERMINED = "und"


def gram_buckets(text: str, bits: int = BITS) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each character, the text being closed by NULs."""
    n = len(text)
    codes = np.zeros(n + max(ORDERS) - 1, np.uint32)
    codes[:n] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(n, np.uint32)
    for k in range(max(ORDERS)):
        with np.errstate(over="ignore"):
            h = (h ^ codes[k : k + n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if k + 1 in ORDERS:
                out.append(((h * np.uint32(0x85EBCA6B) + np.uint32(k)) >> np.uint32(32 - bits)).astype(np.int64))
    return out


def normal(text: str | None) -> str:
    """Lower case, digits as 0; white space and letters stay, as they carry the language."""
    return (text or "").lower().translate(_DIGITS)


_DIGITS = {ord(c): "0" for c in "123456789"}


def stretches(text: str) -> Iterator[list[np.ndarray]]:
    """The buckets of a text, CHUNK characters at a time. A stretch is read with the characters after it that its last
    n-grams need, so all n-grams are those of the whole text."""
    for a in range(0, len(text), CHUNK):
        n = min(CHUNK, len(text) - a)
        yield [g[:n] for g in gram_buckets(text[a : a + CHUNK + max(ORDERS) - 1])]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the matrix of log-probabilities, one row for each bucket, and the languages' log priors: their shares
    of the rows, one added to each count.

    n-grams are counted on the executors; the driver gets one count for each language and bucket seen. Rows without a
    label or with an empty text are left out. Without any row the language list is empty.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
    labelled = labelled.where("lang is not null")
    ids = labelled.select(F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(max_train).select("id").distinct()
    sample = labelled.where("text <> ''").join(F.broadcast(ids), "id", "left_semi").select("lang", "text")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: dict[str, np.ndarray] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                c = counts.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                c[-1] += 1  # documents
                for grams in stretches(normal(text)):
                    for g in grams:
                        c[:-1] += np.bincount(g, minlength=1 << BITS)
            rows = [(lang, b, c[b]) for lang, c in counts.items() for b in np.flatnonzero(c)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "bucket", "n"]
            )

        return each

    got = map_batches(sample, "lang string, bucket int, n bigint", make).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros(((1 << BITS) + 1, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    if langs:
        counts[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    if not langs:
        return langs, np.zeros((1 << BITS, 0), np.float32), np.zeros(0)
    smoothed, docs_of = counts[:-1] + SMOOTHING, counts[-1] + 1
    return langs, np.log(smoothed / smoothed.sum(axis=0, keepdims=True)).astype(np.float32), np.log(docs_of / docs_of.sum())


def score_texts(texts: list[str | None], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log-probabilities (texts x languages) and the number of n-grams of each text."""
    out, grams = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(texts), np.int64)
    for a, b in slices(texts, CHUNK):
        parts = [normal(t) for t in texts[a:b]]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        grams[a:b] += sizes * len(ORDERS)
        if b == a + 1:
            for g in (g for grams_of in stretches(parts[0]) for g in grams_of):
                out[a] += matrix[g].sum(axis=0, dtype=np.float64)
        elif sizes.any():
            starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
            bounds = np.stack([starts, starts + sizes], 1).ravel()
            full = np.flatnonzero(sizes)
            for g in gram_buckets("\0\0".join(parts)):
                rows = np.concatenate([matrix[g], np.zeros((1, matrix.shape[1]), np.float32)])
                sums = np.add.reduceat(rows.astype(np.float64), np.minimum(bounds, len(g)), axis=0)[::2]
                out[a + full] += sums[full]
    return out, grams


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, prior: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, lang_pred, log_prob (that of language and text together, divided by the number
    of n-grams) and margin over the second language.

    The whole text counts, as one. Null and empty texts, and all texts where the model knows no language, get `und` with null
    scores. Equal scores go to the language that comes first in the alphabet. Repeated rows are each answered; a null
    id stays null; other columns of `docs` are ignored.
    """
    share = docs.sparkSession.sparkContext.broadcast((langs, matrix, prior))

    def make():
        langs, matrix, prior = share.value
        names = np.array([*langs, UNDETERMINED], object)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, grams = score_texts(batch["text"].to_pylist(), matrix)
            scores += prior
            known = (grams > 0) & (len(langs) > 0)
            best = np.full(len(grams), len(langs))
            mean = margin = np.zeros(len(grams))
            if langs:
                best = np.where(known, scores.argmax(axis=1), len(langs))
                n = np.maximum(grams, 1)
                top = np.sort(scores, axis=1)
                mean = top[:, -1] / n
                margin = (top[:, -1] - top[:, -2]) / n if len(langs) > 1 else margin
            return pa.RecordBatch.from_arrays([batch["id"], pa.array(names[best], pa.string()), pa.array(mean, mask=~known), pa.array(margin, mask=~known)], names=["doc_id", "lang_pred", "log_prob", "margin"])

        return each

    cols = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_batches(cols, "doc_id bigint, lang_pred string, log_prob double, margin double", make)


def language_id(docs: DataFrame, **names: str) -> DataFrame:
    """Fits on the labelled rows of `docs` (bounded by MAX_TRAIN) and answers all rows; see `identify`."""
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    return identify(docs, *fit(docs, id_col, text_col, names.get("label_col", "lang")), id_col, text_col)
