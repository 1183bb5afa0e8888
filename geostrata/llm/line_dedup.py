"""Line dedup: range-partitioned line hashes, sorted by document and position, stream the first occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches

#: White space at the ends of a line that doesn't count; a line of nothing else is blank.
SPACE = " \t\r"

_LINES = "row bigint, id bigint, digest bigint, n_lines int, h1 binary, h2 binary, pos binary, local binary"


def encode(keep: np.ndarray) -> str:
    """A bitmap as the lengths of its runs, which alternate from kept to dropped lines: [1, 1, 0, 1] is "2,1,1".

    The first length is 0 if the first line is dropped; a text that stays whole takes one number.
    """
    if not len(keep):
        return ""
    ends = np.append(np.flatnonzero(keep[1:] != keep[:-1]) + 1, len(keep))
    runs = np.diff(ends, prepend=0).tolist()
    return ",".join(map(str, runs if keep[0] else [0, *runs]))


def decode(runs: str) -> np.ndarray:
    sizes = [int(x) for x in runs.split(",")] if runs else []
    return np.repeat(np.arange(len(sizes)) % 2 == 0, sizes)


def apply(text: str, runs: str) -> str:
    """The text without its dropped lines."""
    return "\n".join(x for x, k in zip(text.split("\n"), decode(runs)) if k)


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row with a text: the hashes of the lines that are the first of their kind within the Arrow batch, with
    their positions, and the positions (`local`) of the others, which are copies whatever else there is.

    So a line that stands in every document is compared once a batch, not once a document. Blank lines are in neither.
    """
    cols = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.Table:
            ids, rows, texts = (batch[c].to_pylist() for c in ("id", "row", "text"))
            digest = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, digest[i], rows[i]))
            seen: set[bytes] = set()
            out: list = [None] * len(ids)
            for i in order:
                lines = texts[i].split("\n")
                firsts, pos, local = [], [], []
                for p, line in enumerate(lines):
                    if line := line.strip(SPACE):
                        h = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                        if h in seen:
                            local.append(p)
                        else:
                            seen.add(h)
                            firsts.append(h)
                            pos.append(p)
                halves = np.frombuffer(b"".join(firsts), np.int64).reshape(-1, 2)
                out[i] = (len(lines), halves[:, 0].tobytes(), halves[:, 1].tobytes(), np.array(pos, np.int32).tobytes(), np.array(local, np.int32).tobytes())
            n, *parts = zip(*out)
            return pa.table([batch["row"], batch["id"], pa.array(digest, pa.int64()), pa.array(n, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names=["row", "id", "digest", "n_lines", "h1", "h2", "pos", "local"])

        return each

    return map_batches(cols, _LINES, make)


def _exploded(candidates: DataFrame) -> DataFrame:
    """(h1, h2, late, id, digest, row, pos): one row for each candidate line; rows without an id come last."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.Table:
            h1, h2 = (np.frombuffer(b"".join(batch[c].to_pylist()), np.int64) for c in ("h1", "h2"))
            parts = batch["pos"].to_pylist()
            owner = pa.array(np.repeat(np.arange(len(parts)), [len(x) // 4 for x in parts]))
            own = [batch[c].take(owner) for c in ("id", "digest", "row")]
            return pa.table([pa.array(h1), pa.array(h2), own[0].is_null(), *own, pa.array(np.frombuffer(b"".join(parts), np.int32))], names=["h1", "h2", "late", "id", "digest", "row", "pos"])

        return each

    return map_batches(candidates.select("id", "digest", "row", "h1", "h2", "pos"), "h1 bigint, h2 bigint, late boolean, id bigint, digest bigint, row bigint, pos int", make)


def _losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pos) of the lines that aren't the first of their hash; what is kept of the stream is the last hash."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.stack([batch["h1"].to_numpy(), batch["h2"].to_numpy()])
        same = np.concatenate([[last is not None and bool((h[:, 0] == last).all())], (h[:, 1:] == h[:, :-1]).all(axis=0)])
        last = h[:, -1]
        if same.any():
            yield batch.select(["row", "pos"]).filter(pa.array(same))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs` with a text: doc_id, n_lines, n_kept and keep_bitmap (see `encode`).

    A line is kept where it occurs first, in the order of ids and then of positions; white space at its ends doesn't
    count, case does. Blank lines are kept: they hold no text and part paragraphs. An empty text is one blank line. A
    null text gives no row. A null id comes after all others; of repeated rows one keeps its lines; of different texts
    with one id the order is that of their hash. Whole texts count, other columns are ignored, and an empty table gives
    an empty result.

    Hashes of 128 bits, not texts, are moved: they are partitioned by range and sorted by document and position, so the
    first of each is found in one stream. Results go back to the documents as positions of what is dropped.
    """
    held = checkpointed(_candidates(docs, id_col, text_col))
    lines = _exploded(held).repartitionByRange("h1").sortWithinPartitions("h1", "h2", "late", "id", "digest", "row", "pos")
    lost = lines.select("h1", "h2", "row", "pos").mapInArrow(_losers, "row bigint, pos int").groupBy("row").agg(F.collect_list("pos").alias("lost"))
    rows = held.select("row", "id", "n_lines", "local").join(lost, "row", "left").select("id", "n_lines", "local", "lost")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, bits = [], []
            lists = batch["lost"]
            for i, (n, local) in enumerate(zip(batch["n_lines"].to_pylist(), batch["local"].to_pylist())):
                keep = np.ones(n, bool)
                keep[np.frombuffer(local, np.int32)] = False
                if lists[i].is_valid:
                    keep[lists[i].values.to_numpy()] = False
                kept.append(int(keep.sum()))
                bits.append(encode(keep))
            return pa.RecordBatch.from_arrays([batch["id"], batch["n_lines"], pa.array(kept, pa.int32()), pa.array(bits, pa.string())], names=["doc_id", "n_lines", "n_kept", "keep_bitmap"])

        return each

    return map_batches(rows, "doc_id bigint, n_lines int, n_kept int, keep_bitmap string", make)
