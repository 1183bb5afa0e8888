"""Exact dedup: binary-fuse filters of immutable snapshots screen digests; byte checks decide."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, maybe_broadcast

#: Digests that one filter holds on average; a snapshot has as many filters as that takes.
FILTER_KEYS = 500_000
#: Snapshots that a corpus without any is divided into: all but the last are the immutable past, each by its order.
SNAPSHOTS = 4


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (murmur3's) of x + seed."""
    with np.errstate(over="ignore"):
        h = x + np.uint64(seed)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """Static 3-wise binary-fuse filter with 8-bit fingerprints (Graf and Lemire 2022): no false negatives,
    false positives at 1/256, about 9 to 10 bits a key. Keys are distinct 64-bit integers."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots of each hash, in three consecutive segments."""
        wide = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (wide + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (wide + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([wide, second, third]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys)
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        factor = 0 if n < 2 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        segments = max(1, -(-int(n * factor) // segment) - 2)
        for seed in range(1, 200):
            h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            slots = cls._slots(h, segment, segments)
            order = cls._peel(slots, (segments + 2) * segment)
            if order is not None:
                break
            if seed % 20 == 0:
                segments += max(1, segments // 10)
        else:  # pragma: no cover - each attempt fails with a small probability
            raise RuntimeError("no seed peels this set")
        prints = np.zeros((segments + 2) * segment, np.uint8)
        want = cls._prints(h)
        for layer, own in reversed(order):  # own: the slot that only this key of the layer touches
            others = slots[:, layer]
            prints[own] = want[layer] ^ np.bitwise_xor.reduce(np.where(others == own, 0, prints[others]), axis=0)
        return cls(seed, segment, segments, prints)

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Layers of (keys, their own slots); keys of a layer don't share own slots. None if a core is left."""
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        which = np.zeros(size, np.int64)  # xor of the keys that touch a slot
        for row in slots:
            np.bitwise_xor.at(which, row, np.arange(n))
        layers, left = [], n
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, first = np.unique(which[alone], return_index=True)
            layers.append((key, alone[first]))
            left -= len(key)
            touched = slots[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            np.bitwise_xor.at(which, touched.ravel(), np.tile(key, 3))
            near = np.unique(touched)
            alone = near[count[near] == 1]
        return layers if not left else None

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys, self.seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        found = np.bitwise_xor.reduce(self.prints[self._slots(h, self.segment, self.segments)], axis=0)
        return found == self._prints(h)


def digest(text_col: str) -> tuple[Column, Column]:
    """The two 64-bit halves of the MD5 of a text's bytes."""
    md5 = F.md5(F.col(text_col))
    return tuple(F.conv(F.substring(md5, a, 16), 16, -10).cast("bigint") for a in (1, 17))


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, d1 and d2 of the rows whose text isn't null."""
    one, two = digest(text_col)
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), one.alias("d1"), two.alias("d2"))


def build_filters(digests: DataFrame) -> DataFrame:
    """(snapshot, bucket, filter) of distinct digests (snapshot, bucket, d1): one static filter for each bucket."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(pdf["d1"].to_numpy().astype(np.int64).view(np.uint64))
        return pd.DataFrame({"snapshot": pdf["snapshot"].iloc[:1], "bucket": pdf["bucket"].iloc[:1], "seed": f.seed, "segment": f.segment, "segments": f.segments, "prints": [f.prints.tobytes()]})

    return digests.groupBy("snapshot", "bucket").applyInPandas(build, "snapshot int, bucket int, seed int, segment int, segments int, prints binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows (d1, d2, snapshot, bucket, …) that the filter of an earlier snapshot may hold, in place of all rows.

    Rows and filters of a bucket meet in one task, so a filter is never sent to all executors. Rows are distinct digests, so
    a bucket has about as many of them as its filters are made for, however often a text occurs.
    """

    def run(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows
        keys, batch = rows["d1"].to_numpy().astype(np.int64).view(np.uint64), rows["snapshot"].to_numpy()
        hit = np.zeros(len(rows), bool)
        for p in parts.itertuples():
            later = np.flatnonzero((batch > p.snapshot) & ~hit)
            f = BinaryFuse(p.seed, p.segment, p.segments, np.frombuffer(p.prints, np.uint8))
            hit[later] = f.contains(keys[later])
        return rows[hit]

    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(run, incoming.schema)


def bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("bucket", F.pmod("d2", F.lit(buckets)).cast("int"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", snapshots: int = SNAPSHOTS, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """(doc_id, keep_id, n_rows, d1, d2): the ids whose rows aren't the first of their bytes; keep_id is the lowest id.

    The corpus arrives in `snapshots` batches by ranges of the id. Every batch but the last leaves an immutable
    snapshot with its filters. Within a batch rows of one digest are counted before anything else, so copies meet the filters
    as one. A digest that no earlier filter may hold is new; it meets only its own batch. The
    others join the exact buckets of digests. Where digests agree, the bytes are compared, so a collision never drops a row.
    For batches that arrive one after another see `Snapshots`.

    A null text is no copy of anything; empty texts are copies of each other. A null id comes after all others. n_rows
    is the number of surplus rows of an id (1 but for repeated rows); where a row is repeated, id included, keep_id may
    be doc_id. d1 and d2 are the digest. Other columns are ignored. An empty table gives an empty result.
    """
    texts = digested(docs, id_col, text_col)
    d = checkpointed(texts.select("id", "d1", "d2"))
    low, high, n = d.agg(F.min("id"), F.max("id"), F.count("*")).first()
    low, high = low or 0, high or 0
    part = (F.col("id").cast("double") - float(low)) / float(high - low + 1) * snapshots  # ids may span more than a bigint
    batch = F.coalesce(F.least(F.floor(part), F.lit(snapshots - 1)), F.lit(snapshots - 1)).cast("int")
    counted = d.groupBy(batch.alias("snapshot"), "d1", "d2").agg(F.count("*").alias("n"))
    counted = checkpointed(bucketed(counted, max(1, -(-n // (filter_keys * snapshots)))))
    filters = build_filters(counted.where(F.col("snapshot") < snapshots - 1).select("snapshot", "bucket", "d1"))
    positive = screen(counted.where(F.col("snapshot") > 0).select("d1", "d2", "snapshot", "bucket"), filters).select("d1", "d2")
    within = counted.where("n > 1").select("d1", "d2")
    # the exact buckets: digests that more than one row has, of those that were screened out or met in their own batch
    suspects = checkpointed(counted.join(positive.union(within).distinct(), ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(F.sum("n").alias("n")).where("n > 1").select("d1", "d2"))
    # equal bytes collapse within each map task before the shuffle, so thousands of copies cost one text a task
    groups = texts.join(maybe_broadcast(suspects), ["d1", "d2"], "left_semi").groupBy("d1", "d2", "text").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    firsts = checkpointed(groups.groupBy("d1", "d2").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")))
    out = _surplus(d.groupBy("d1", "d2", "id").count(), firsts.where("texts = 1 and n > 1"), ["d1", "d2"])
    clash = firsts.where("texts > 1").select("d1", "d2")
    if clash.limit(1).count():  # equal digests of different bytes: these few go by their bytes throughout
        rows = texts.join(clash, ["d1", "d2"], "left_semi")
        own = rows.groupBy("d1", "d2", "text").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
        out = out.union(_surplus(rows.groupBy("d1", "d2", "text", "id").count(), own, ["d1", "d2", "text"]))
    return out


class Snapshots:
    """Immutable snapshots of texts in a folder: their distinct texts with digests, and a static filter for each bucket.

    Files of a snapshot are written once and never changed. `buckets` is fixed with the first snapshot: as many as
    let a filter hold about FILTER_KEYS keys of one snapshot of the size that is expected.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def numbers(self) -> list[int]:
        """Snapshots that are whole: filters are written last, and a folder without its mark of success doesn't count."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/filters/snapshot=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found or [])

    def _read(self, kind: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.folder}/{kind}/snapshot={k}").withColumn("snapshot", F.lit(k)) for k in self.numbers()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def screened(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, keep_id, snapshot, n_rows): the rows of a new batch that are copies.

        Digests that no filter may hold are new; only the others read the stored texts of their buckets, where digests
        and then bytes are compared: keep_id and snapshot are those of the earliest snapshot that holds the text. What
        is left is grouped within the batch: there snapshot is null and keep_id the lowest id of the batch. Null texts are no
        copies; n_rows is as in `duplicates`; an empty batch or folder gives no row from the snapshots.
        """
        texts = digested(docs, id_col, text_col)
        rows = checkpointed(texts.groupBy("d1", "d2", "id").count())
        filters, stored = self._read("filters"), self._read("texts")
        known = None
        if filters is not None:
            fresh = bucketed(rows.select("d1", "d2").distinct(), self.buckets).withColumn("snapshot", F.lit(2**31 - 1))
            positive = checkpointed(screen(fresh.select("d1", "d2", "snapshot", "bucket"), filters).select("d1", "d2", "bucket"))
            old = stored.join(maybe_broadcast(positive), ["bucket", "d1", "d2"], "left_semi")
            mine = texts.join(maybe_broadcast(positive), ["d1", "d2"], "left_semi").groupBy("d1", "d2", "text").agg(F.count("*").alias("n"))
            first = F.min(F.struct("snapshot", "id")).alias("first")
            known = checkpointed(mine.join(old, ["d1", "d2", "text"]).groupBy("d1", "d2", "text").agg(first).select("d1", "d2", "text", "first.*"))
            hits = texts.join(known.withColumnRenamed("id", "keep_id"), ["d1", "d2", "text"]).groupBy("id", "keep_id", "snapshot").count()
            out = hits.select(F.col("id").alias("doc_id"), "keep_id", "snapshot", F.col("count").alias("n_rows"))
            texts = texts.join(known.select("d1", "d2", "text"), ["d1", "d2", "text"], "left_anti")
        own = duplicates(texts, "id", "text").select("doc_id", "keep_id", F.lit(None).cast("int").alias("snapshot"), "n_rows")
        return own if known is None else out.unionByName(own)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Stores the distinct texts of `docs`, each with its lowest id, and their filters as the next snapshot."""
        number = max(self.numbers(), default=-1) + 1
        firsts = bucketed(digested(docs, id_col, text_col).groupBy("d1", "d2", "text").agg(F.min("id").alias("id")), self.buckets)
        firsts.repartition("bucket").sortWithinPartitions("bucket", "d1").write.mode("overwrite").parquet(f"{self.folder}/texts/snapshot={number}")
        digests = self.spark.read.parquet(f"{self.folder}/texts/snapshot={number}").select(F.lit(number).alias("snapshot"), "bucket", "d1").distinct()
        build_filters(digests).drop("snapshot").write.mode("overwrite").parquet(f"{self.folder}/filters/snapshot={number}")
        return number


def _surplus(ids: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Of ids with a count of their rows, those that have rows besides the first of their group."""
    n = F.col("count") - F.when(F.col("id").eqNullSafe(F.col("keep_id")), 1).otherwise(0)
    return ids.join(firsts.select(*keys, "keep_id"), keys).select(F.col("id").alias("doc_id"), "keep_id", n.alias("n_rows"), "d1", "d2").where("n_rows > 0")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, without copies: of equal bytes the row with the lowest id stays.

    Of rows that agree in id and bytes one stays, whichever. Helper columns start with `__ed_`, so none clashes.
    """
    gone = checkpointed(duplicates(docs, id_col, text_col))
    one, two = digest(text_col)
    rows = docs.withColumns({"__ed_1": one, "__ed_2": two})
    keyed = lambda x: x.select(F.col("doc_id").alias("__ed_id"), F.col("d1").alias("__ed_a"), F.col("d2").alias("__ed_b"))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__ed_id")) & (F.col("__ed_1") == F.col("__ed_a")) & (F.col("__ed_2") == F.col("__ed_b"))
    other = keyed(gone.where("not (doc_id <=> keep_id)"))
    out = rows.join(maybe_broadcast(other), same, "left_anti")
    again = keyed(gone.where("doc_id <=> keep_id"))
    if again.limit(1).count():
        again = maybe_broadcast(again)
        once = out.join(again, same, "left_semi").dropDuplicates([id_col, "__ed_1", "__ed_2"])
        out = out.join(again, same, "left_anti").unionByName(once)
    return out.drop("__ed_1", "__ed_2")
