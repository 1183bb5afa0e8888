"""N-gram Jaccard join: the rarest features of each set find all candidates, exact set intersections decide."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, maybe_broadcast, whole_keys

#: Words of an n-gram, and the least Jaccard similarity of a pair.
N = 3
THRESHOLD = 0.6
#: PartEnum: first-level parts of the feature domain, second-level parts of each, and how many of these must agree.
PARTS, SUBPARTS, AGREE = 3, 5, 3
#: Features of a chunk of sets, whose features are counted together, and of a place that counts, about.
CHUNK, PLACE = 1 << 19, 1 << 20
#: Documents of one tile; a verification task compares two tiles.
TILE = 512
#: Sizes of a band grow by this power of 1 / threshold, so that few sets reach into the next band.
BAND_POWER = 4

_WORD = re.compile(r"\w+")
_SUBSETS = np.array([[p * SUBPARTS + i for i in c] for p in range(PARTS) for c in combinations(range(SUBPARTS), AGREE)])
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _A
        h = (h ^ (h >> np.uint64(27))) * _B
        return h ^ (h >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, computed once for each word while it is kept."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def features(texts: list[str | None], n: int = N, known: Words | None = None) -> list[np.ndarray]:
    """The set of hashed word n-grams of each text, sorted. A text of fewer than n words has one feature, all its
    words; a text without words has none. Case and punctuation don't count."""
    known = Words() if known is None else known
    words, sizes = [], []
    for t in texts:
        w = _WORD.findall(t.lower()) if t else []
        words.extend(w)
        sizes.append(len(w))
    if len(known) > 300_000:
        known.clear()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out, at = [], 0
    with np.errstate(over="ignore"):
        grams = mix(hashes + np.uint64(n))
        for k in range(1, n):
            rest = hashes[k:]
            grams[: len(rest)] = mix(grams[: len(rest)] * _GOLD + rest)
        for size in sizes:
            if size >= n:
                out.append(np.unique(grams[at : at + size - n + 1]))
            elif size:
                h = mix(hashes[at : at + 1] + np.uint64(n))
                for k in range(1, size):
                    h = mix(h * _GOLD + hashes[at + k])
                out.append(mix(h + np.uint64(size)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += size
    return out


def least_shared(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many of its features a set shares with any other set that is similar to it, at least."""
    return np.maximum(np.ceil(threshold * sizes - 1e-6), 1).astype(np.int64)


def bands(sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The size band of each set, and whether a set of the next band may be similar to it."""
    width = BAND_POWER * np.log(1 / threshold) if threshold < 1 else 1.0
    band = np.floor(np.log(sizes) / width + 1e-9)
    return band.astype(np.int64), np.ceil(sizes / threshold + 1e-9) >= np.exp((band + 1) * width) - 1e-6


def signatures(coordinates: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature): one for each band and each subset of AGREE second-level parts within a first-level part.

    If two sets differ in at most SUBPARTS - AGREE coordinates of some first-level part, they share a signature; that
    holds for all pairs that differ in at most PARTS * (SUBPARTS - AGREE + 1) - 1 coordinates. No query uses this any more:
    what similar sets differ in has no such bound (see `_attached`).
    """
    band, reach = bands(sizes, threshold)
    rows = np.concatenate([np.arange(len(sizes)), np.flatnonzero(reach)])
    band = np.concatenate([band, band[reach] + 1])
    with np.errstate(over="ignore"):
        sig = mix(np.arange(len(_SUBSETS), dtype=np.uint64) + np.uint64(1))[None, :] ^ mix(band.astype(np.uint64) + np.uint64(77))[:, None]
        for k in range(AGREE):
            sig = mix(sig * _GOLD + coordinates[rows][:, _SUBSETS[:, k]])
    return np.repeat(rows, len(_SUBSETS)), sig.ravel().view(np.int64)


def fingerprints(raw: list[bytes]) -> np.ndarray:
    """128-bit hashes of the bytes of sets, as two columns."""
    return np.array([divmod(xxhash.xxh3_128_intdigest(r), 1 << 64) for r in raw], np.uint64).reshape(-1, 2).view(np.int64)


def _digest(text: Column) -> tuple[Column, Column]:
    """Two hashes that, with the id, are the key of a row."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _extracted(docs: DataFrame, id_col: str, text_col: str, n: int, sets: str = "") -> DataFrame:
    """id, 128-bit digest (t1, t2) of the text, size and 128-bit fingerprint (p1, p2) of the feature set of each text,
    with its features (feats) if `sets` is a type, binary or array<bigint>, for them. Texts without words have size 0."""
    digest = [c.alias(t) for c, t in zip(_digest(F.col(text_col)), ("t1", "t2"))]
    cols = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *digest).where("id is not null")

    names = ["id", "t1", "t2", "size", "p1", "p2", *["feats"] * bool(sets)]

    def make():
        known = Words()

        def each(batch: pa.RecordBatch) -> pa.Table | None:
            parts = []
            for a in range(0, batch.num_rows, 200):
                found = features(batch["text"].slice(a, 200).to_pylist(), n, known)
                raw = [s.tobytes() for s in found]
                prints = fingerprints(raw)
                keys = batch.select(["id", "t1", "t2"]).slice(a, len(found))
                cols = [*keys.columns, pa.array([len(x) for x in found], pa.int32()), pa.array(prints[:, 0]), pa.array(prints[:, 1])]
                if sets == "binary":
                    cols.append(pa.array(raw, pa.binary()))
                elif sets:
                    cols.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), np.concatenate(found).view(np.int64)))
                parts.append(pa.table(cols, names=names))
            return pa.concat_tables(parts) if parts else None

        return each

    return map_batches(cols, "id bigint, t1 bigint, t2 bigint, size int, p1 bigint, p2 bigint" + f", feats {sets}" * bool(sets), make)


def _chunk(number: int, sets: dict[bytes, np.ndarray], places: int) -> pa.RecordBatch:
    """(chunk, place, data, docs): for each place the 32-bit keys of the features that it counts, with their sets'
    numbers in the chunk; for a negative place, so that it isn't one for all chunks, the sets' fingerprints and sizes."""
    sizes = np.array([len(s) for s in sets.values()], np.int32)
    flat, doc = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    place = ((flat >> np.uint64(40)) * np.uint64(places) >> np.uint64(24)).astype(np.uint16)
    order = np.argsort(place, kind="stable")
    keys, doc, place = flat.astype(np.uint32)[order], doc[order], place[order]
    ends = _ends(place)
    cuts = list(zip([0, *ends[:-1]], ends))
    at = [-1 - number % 1024, *(int(place[a]) for a, _ in cuts)]
    data, docs = [b"".join(sets), *(keys[a:b].tobytes() for a, b in cuts)], [sizes.tobytes(), *(doc[a:b].tobytes() for a, b in cuts)]
    return pa.RecordBatch.from_arrays([pa.array([number] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(data, pa.binary()), pa.array(docs, pa.binary())], names=["chunk", "place", "data", "docs"])


def _sharing(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, total: int) -> DataFrame:
    """(p1, p2) of the sets that share as many features with any other sets as a partner would have in common with them
    (see `least_shared`); the others have no partner. `total` is the number of features.

    Chunks of sets send their features to places by range, which answer how many of each set's are not alone. A key in a
    place has 32 bits: where two features have the same one they count as shared, so a set may be kept too many, none too
    few. The same goes for equal sets of different chunks.
    """
    places = min(max(1, -(-total // PLACE)), 1 << 16)

    def send(batches):
        known, sets, held, number = Words(), {}, 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                own = [s for s in features(batch["text"].slice(a, 200).to_pylist(), n, known) if len(s)]
                prints = fingerprints([s.tobytes() for s in own])
                sets.update((p.tobytes(), s) for p, s in zip(prints, own))
                held += sum(map(len, own))
                if held >= CHUNK or len(sets) > 60_000:
                    yield _chunk(number, sets, places)
                    sets, held, number = {}, 0, number + 1
        if sets:
            yield _chunk(number, sets, places)

    def count(batches):
        for t in whole_keys(batches, "place"):
            place, data, lists = t["place"].to_numpy(), t["data"].to_pylist(), t["docs"].to_pylist()
            a = 0
            for b in _ends(place):
                if place[a] < 0:
                    yield pa.RecordBatch.from_arrays([t["chunk"].slice(a, b - a).combine_chunks(), pa.array(data[a:b], pa.binary()), pa.array(lists[a:b], pa.binary()), pa.nulls(b - a, pa.binary())], names=["chunk", "sets", "docs", "counts"])
                else:
                    keys = np.frombuffer(b"".join(data[a:b]), np.uint32)
                    order = np.argsort(keys)
                    same = keys[order[1:]] == keys[order[:-1]]
                    shared = np.zeros(len(keys), bool)
                    shared[order[1:][same]] = shared[order[:-1][same]] = True
                    own, found, at = [], [], 0
                    for x in lists[a:b]:
                        x = np.frombuffer(x, np.uint16)
                        doc, many = np.unique(x[shared[at : at + len(x)]], return_counts=True)
                        own.append(doc.tobytes())
                        found.append(many.astype(np.int32).tobytes())
                        at += len(x)
                    yield pa.RecordBatch.from_arrays([t["chunk"].slice(a, b - a).combine_chunks(), pa.nulls(b - a, pa.binary()), pa.array(own, pa.binary()), pa.array(found, pa.binary())], names=["chunk", "sets", "docs", "counts"])
                a = b

    def decide(batches):
        for t in whole_keys(batches, "chunk"):
            sets, lists, counts, a = t["sets"].to_pylist(), t["docs"].to_pylist(), t["counts"].to_pylist(), 0
            for b in _ends(t["chunk"].to_numpy()):
                k = next(k for k in range(a, b) if sets[k] is not None)
                sizes, prints = np.frombuffer(lists[k], np.int32), np.frombuffer(sets[k], np.int64).reshape(-1, 2)
                shared = np.zeros(len(sizes), np.int64)
                for i in range(a, b):
                    if i != k:
                        shared[np.frombuffer(lists[i], np.uint16)] += np.frombuffer(counts[i], np.int32)
                prints = prints[shared >= least_shared(sizes, threshold)]
                yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["p1", "p2"])
                a = b

    texts = docs.where(F.col(id_col).cast("bigint").isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    sent = texts.mapInArrow(send, "chunk bigint, place int, data binary, docs binary").repartition("place").sortWithinPartitions("place")
    counted = sent.mapInArrow(count, "chunk bigint, sets binary, docs binary, counts binary")
    return counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(decide, "p1 bigint, p2 bigint").distinct()


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(sig, id) of the sets (id, size, feats): one for each feature of the set's prefix and each of its size bands.

    The prefix of a set is what it has too many of to miss them all: of its features, the rarest first, those that are more
    than it may have without a partner, `size - least_shared + 1`. Two similar sets, of which each shares as many with the
    other, have one of them in common. Features that no other set has come first and need no signature.
    """

    def count(batches):
        for t in whole_keys(batches, "feature"):
            feature, ids = t["feature"].to_numpy(), t["id"].to_numpy()
            new = np.concatenate([[True], feature[1:] != feature[:-1]])
            once = np.flatnonzero(new | np.concatenate([[True], ids[1:] != ids[:-1]]))  # repeated rows count once
            first = np.flatnonzero(new[once])
            many = np.diff(np.append(first, len(once)))
            many = np.repeat(many, many)
            keep = once[many > 1]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(t["size"].to_numpy()[keep]), pa.array(many[many > 1]), pa.array(feature[keep])], names=["id", "size", "df", "feature"])

    def sign(batches):
        for t in whole_keys(batches, "id"):
            ids, size = t["id"].to_numpy(), t["size"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            shared = np.diff(np.append(first, len(ids)))
            rank = np.arange(len(ids)) - np.repeat(first, shared)
            keep = rank < np.repeat(shared - least_shared(size[first], threshold) + 1, shared)
            if keep.any():
                ids, feature = ids[keep], t["feature"].to_numpy()[keep].view(np.uint64)
                band, reach = bands(size[keep].astype(float), threshold)
                band, ids, feature = np.append(band, band[reach] + 1), np.append(ids, ids[reach]), np.append(feature, feature[reach])
                sig = mix(feature ^ mix(band.astype(np.uint64) + np.uint64(77)))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids)], names=["sig", "id"])

    rows = sets.select(F.explode("feats").alias("feature"), "id", "size")  # not in Python, as a task would need two workers
    rows = rows.repartition("feature").sortWithinPartitions("feature", "id").mapInArrow(count, "id bigint, size int, df bigint, feature bigint")
    return rows.repartition("id").sortWithinPartitions("id", "df", "feature").mapInArrow(sign, "sig bigint, id bigint")


def _attached(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """(lead, id): each set (id, doc, size, p1, p2) and the lowest id of each group with which it shares a signature.

    Any two similar sets share one, whatever their similarity and size. First the sets whose features hardly any other set
    has are left out, as they can't have a partner; the signatures of the others are the rarest of their features.
    This is linear in the size of a group, however large: what a group has in common is its lead.
    """
    total = reps.agg(F.sum(F.col("size").cast("bigint"))).first()[0] or 0
    wanted = checkpointed(reps.join(_sharing(docs, id_col, text_col, n, threshold, total), ["p1", "p2"]).select("id", "doc", "p1", "p2", "n"))
    prefixes = _prefixes(_again(wanted, docs, id_col, text_col, n, "array<bigint>"), threshold)

    def run(batches):
        for t in whole_keys(batches, "sig"):
            sig, ids = t["sig"].to_numpy(), t["id"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            sizes = np.diff(np.append(first, len(sig)))
            lead = np.repeat(ids[first], sizes)
            many = np.repeat(sizes > 1, sizes)
            if many.any():
                pairs = np.unique(np.stack([lead[many], ids[many]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["lead", "id"])

    return prefixes.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(run, "lead bigint, id bigint").distinct()


def _handled(tile: np.ndarray, same: bool, comp: np.ndarray, lead: int, leads: list) -> np.ndarray:
    """Which pairs of a block are its own: those of its two tiles (of its one tile, if `same`) that are in different
    components and whose lowest common lead is that of the block."""
    n = len(leads)
    own = np.triu(np.ones((n, n), bool), 1) if same else tile[:, None] < tile[None, :]
    own &= comp[:, None] != comp[None, :]
    sizes = np.array([len(x) for x in leads])
    flat, owner = np.concatenate(leads), np.repeat(np.arange(n), sizes)
    lower = flat < lead
    if lower.any():
        names, col = np.unique(flat[lower], return_inverse=True)
        m = np.zeros((n, len(names)), np.float32)
        m[owner[lower], col] = 1
        own &= ~(m @ m.T > 0)
    return own


def _ends(block: np.ndarray) -> list[int]:
    """Where runs of equal values end."""
    return np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)).tolist()


def _blocks(attached: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """(block, lead, id, tile, same, comp, leads): the documents that each block compares.

    The documents of a lead are cut into tiles; a block holds two tiles, so no task grows with the size of a group.
    Only documents with a pair that is the block's own are in it. Without `comps` every pair is looked at. With `comps`
    (id, root) only pairs that these components don't link are: those that are in their lead's component don't meet each
    other, and groups that one component holds are left out.
    """
    leads = attached.groupBy("id").agg(F.array_sort(F.collect_set("lead")).alias("leads"))
    if comps is None:
        rows = attached.withColumns({"comp": F.col("id"), "far": F.lit(True)})
    else:
        of = lambda c, name: comps.select(F.col("id").alias(c), F.col("root").alias(name))
        rows = attached.join(of("id", "comp"), "id", "left").join(of("lead", "base"), "lead", "left")
        rows = rows.select("lead", "id", F.coalesce("comp", "id").alias("comp"), (F.coalesce("comp", "id") != F.coalesce("base", "lead")).alias("far"))
    share = lambda x: F.ceil(F.sum(F.when(x, 1).otherwise(0)) / TILE).cast("int")
    tiles = rows.groupBy("lead").agg(share(F.col("far")).alias("fars"), share(~F.col("far")).alias("nears")).where("fars > 0")
    rows = rows.join(tiles, "lead").join(leads, "id")
    # tiles of far documents meet all tiles, those of near ones meet the far ones only
    rows = rows.withColumn("tile", F.when(F.col("far"), F.pmod(F.xxhash64("id"), "fars")).otherwise(F.col("fars") + F.pmod(F.xxhash64("id"), "nears")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("fars") - 1 + F.when(F.col("far"), F.col("nears")).otherwise(0))))
    rows = rows.select(F.xxhash64("lead", F.least("tile", "other"), F.greatest("tile", "other")).alias("block"), "lead", "id", "tile", (F.col("tile") == F.col("other")).alias("same"), "comp", "leads")
    rows = rows.repartition("block").sortWithinPartitions("block", "id")

    def run(batches):
        for t in whole_keys(batches, "block"):
            block = t["block"].to_numpy()
            lead, tile, comp, lists = t["lead"].to_numpy(), t["tile"].to_numpy(), t["comp"].to_numpy(), t["leads"].combine_chunks()
            same = t["same"].to_pylist()
            flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            keep, a = np.zeros(len(block), bool), 0
            for b in _ends(block):
                if b - a > 1:
                    own = _handled(tile[a:b], same[a], comp[a:b], int(lead[a]), [flat[at[i] : at[i + 1]] for i in range(a, b)])
                    keep[a:b] = own.any(axis=0) | own.any(axis=1)
                a = b
            if keep.any():
                yield from t.filter(pa.array(keep)).to_batches()

    return rows.mapInArrow(run, rows.schema)


def _again(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, kind: str) -> DataFrame:
    """(id, n, size, feats) of the representatives `wanted`, extracted again from their texts only. `kind` is the type
    of feats."""
    few = maybe_broadcast(wanted)
    texts = docs.where(F.col(text_col).isNotNull()).join(few.select(F.col("doc").alias("__nd_id")), F.col(id_col).cast("bigint") == F.col("__nd_id"), "left_semi")
    sets = _extracted(texts, id_col, text_col, n, kind).select(F.col("id").alias("doc"), "p1", "p2", "size", "feats")
    return sets.join(few, ["doc", "p1", "p2"]).select("id", "n", "size", "feats")


def _with_features(rows: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """`rows` (block, id, …) with the documents' features and the size of their class, each block in one place. Features
    are extracted again, of these documents only."""
    wanted = checkpointed(rows.select("id").distinct().join(reps.select("id", "doc", "p1", "p2", "n"), "id"))
    sets = _again(wanted, docs, id_col, text_col, n, "binary").select("id", "n", "feats")
    return sets.join(rows, "id").repartition("block").sortWithinPartitions("block", "id")


EDGES = "a bigint, b bigint, jaccard double, links bigint"


def _edges(a, b, j) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(j), pa.nulls(len(j), pa.int64())], names=["a", "b", "jaccard", "links"])


def _starred(attached: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """(a, b, jaccard, null) of the documents that are similar to a lead of theirs: each is sent once for each lead, the lead
    once for each tile of its documents, so this is linear however large a group is."""
    others = attached.where("id <> lead")
    tiles = others.groupBy("lead").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = others.join(tiles, "lead").select("lead", "id", F.pmod(F.xxhash64("id"), "tiles").alias("tile"))
    rows = rows.union(tiles.select("lead", F.col("lead").alias("id"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("tiles") - 1).cast("bigint"))).alias("tile")))
    rows = checkpointed(rows.select(F.xxhash64("lead", "tile").alias("block"), "lead", "id"))

    def run(batches):
        for t in whole_keys(batches, "block"):
            ids, lead, feats = t["id"].to_numpy(), t["lead"].to_numpy(), t["feats"].to_pylist()
            out, a = [], 0
            for b in _ends(t["block"].to_numpy()):
                x = np.arange(a, b)[ids[a:b] != lead[a]]
                centre = np.frombuffer(feats[a + int((ids[a:b] == lead[a]).argmax())], np.uint64)
                a = b
                if len(x):
                    j = to_one(centre, [np.frombuffer(feats[i], np.uint64) for i in x])
                    good = j >= threshold - 1e-12
                    out.append((ids[x[good]], lead[x[good]], j[good]))
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))

    return _with_features(rows, reps, docs, id_col, text_col, n).select("block", "lead", "id", "feats").mapInArrow(run, EDGES)


def to_one(centre: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarity of each of the non-empty sets to one (all sorted)."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    hit = centre[np.minimum(np.searchsorted(centre, flat), len(centre) - 1)] == flat
    both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype(float)
    return both / (sizes + len(centre) - both)


def _verify(blocks: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, all_pairs: bool) -> DataFrame:
    """Of the blocks' own pairs that reach the threshold: (a, b, jaccard, null) for `all_pairs`; else as many of these
    as link what all link within a block, and (id, null, null, links) with the number of documents it is similar to."""
    sent = _with_features(blocks, reps, docs, id_col, text_col, n).select("block", "lead", "id", "tile", "same", "comp", "leads", "n", "feats")

    def run(batches):
        for t in whole_keys(batches, "block"):
            ids, lead, tile, comp, weight = (t[c].to_numpy() for c in ("id", "lead", "tile", "comp", "n"))
            leads, feats, same = t["leads"].to_pylist(), t["feats"].to_pylist(), t["same"].to_pylist()
            out, found, links, a = [], [], [], 0
            for b in _ends(t["block"].to_numpy()):
                once = a + np.unique(ids[a:b], return_index=True)[1]  # repeated rows count once
                if len(once) > 1:
                    own = _handled(tile[once], same[a], comp[once], int(lead[a]), [np.array(leads[i]) for i in once])
                    x, y = np.nonzero(own)
                    j = jaccards(x, y, [np.frombuffer(feats[i], np.uint64) for i in once])
                    good = j >= threshold - 1e-12
                    x, y, j = x[good], y[good], j[good]
                    if len(x) and not all_pairs:
                        w = weight[once].astype(float)
                        degree = np.bincount(x, w[y], len(once)) + np.bincount(y, w[x], len(once))
                        found.append(ids[once[degree > 0]])
                        links.append(degree[degree > 0].astype(np.int64))
                        good = spanning(len(once), x, y)
                        x, y, j = x[good], y[good], j[good]
                    out.append((ids[once[x]], ids[once[y]], j))
                a = b
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))
            if found:
                some = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.float64()), pa.array(np.concatenate(links))], names=["a", "b", "jaccard", "links"])

    return sent.mapInArrow(run, EDGES)


def spanning(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of edges (x, y) that link what all of them link among n nodes."""
    root, used = list(range(n)), []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            used.append(k)
            if len(used) == n - 1:
                break
    return np.array(used, np.int64)


def jaccards(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarity of the pairs of sets (x[i], y[i])."""
    sizes = np.array([len(s) for s in sets])
    if len(x) < 8:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist())], float)
        return both / (sizes[x] + sizes[y] - both)
    # features that one set only has don't matter; the others become columns of a 0/1 matrix, a stretch at a time
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    use = shared[col]
    owner, col = np.repeat(np.arange(len(sets)), sizes)[use], (np.cumsum(shared) - 1)[col[use]]
    order = np.argsort(col, kind="stable")
    owner, col, width = owner[order], col[order], int(shared.sum())
    common = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, width, 4096):
        f, t = np.searchsorted(col, [k, k + 4096])
        m = np.zeros((len(sets), min(4096, width - k)), np.float32)
        m[owner[f:t], col[f:t] - k] = 1
        common += m @ m.T
    both = common[x, y].astype(np.float64)
    return both / (sizes[x] + sizes[y] - both)


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, t1, t2, rep, n) of the classes of equal sets, rep being the number of the class and n its size; the
    texts (id, t1, t2) without words; one representative (id, doc, size, p1, p2, n) of each class, whose id is
    the class's number. An id with several texts is a member with each of them."""
    row = F.struct("p1", "p2", "size")
    ids = checkpointed(_extracted(docs, id_col, text_col, n).groupBy("id", "t1", "t2").agg(F.min(row).alias("r")).select("id", "t1", "t2", "r.*"))
    full = ids.where("size > 0")
    classes = full.groupBy("p1", "p2", "size").agg(F.min(F.struct("id", "t1", "t2")).alias("first"), F.count("*").alias("n"))
    classes = checkpointed(classes.withColumn("rep", F.monotonically_increasing_id()))
    members = checkpointed(full.join(classes, ["p1", "p2", "size"]).select("id", "t1", "t2", "rep", "n"))
    reps = full.join(classes.select("first.*", "rep", "n"), ["id", "t1", "t2"]).select(F.col("rep").alias("id"), F.col("id").alias("doc"), "size", "p1", "p2", "n")
    return members, ids.where("size = 0").select("id", "t1", "t2"), reps


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs (doc_a, doc_b, jaccard) of representatives whose sets of word n-grams have a Jaccard similarity of at least
    `threshold`, and membership (doc_id, rep_id, n): documents with equal sets have one representative, the lowest id.

    Every text is a query and none has a cap on its partners; that all pairs of different sets are returned is what this
    function is for, so a group of k near copies gives up to k² / 2 (see `links` and `deduplicated` for less). The
    similarity is exact and no pair is missed (see `_attached`). Null and empty texts, texts without words and null ids are in neither table. Repeated rows count once;
    an id with several texts takes part with each of them. An empty table gives empty results.
    """
    members, _, reps = _classes(docs, id_col, text_col, n)
    blocks = checkpointed(_blocks(checkpointed(_attached(reps, docs, id_col, text_col, n, threshold))))
    pairs = _verify(blocks, reps, docs, id_col, text_col, n, threshold, True)
    names = members.groupBy("rep").agg(F.min("id").alias("doc"))
    left, right = names.select(F.col("rep").alias("a"), F.col("doc").alias("x")), names.select(F.col("rep").alias("b"), F.col("doc").alias("y"))
    pairs = pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return pairs, members.join(names, "rep").select(F.col("id").alias("doc_id"), F.col("doc").alias("rep_id"), "n")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each text of `docs`. n_links is the number of other texts whose set of word
    n-grams has a Jaccard similarity of at least `threshold` to its own; class_id is the lowest id of the class of
    documents that such links connect.

    Every text is a query against all others, without a cap on partners; pairs are counted where they are compared and
    never emitted. Equal sets are searched for once and count with all their documents. Tiles of a group are compared
    with each other in tasks of their own, so that no task grows with a group; the number of such tasks grows with the
    square of the number of *different* sets in it, as each of their links is counted. The similarity is exact and no pair
    is missed (see `_attached`).

    Null and empty texts and texts without words are classes of their own without links. A null id gives no row.
    Repeated rows count once; an id with several texts has a row for each of them. Other columns are ignored; an empty
    table gives no row.
    """
    members, empty, reps = _classes(docs, id_col, text_col, n)
    blocks = checkpointed(_blocks(checkpointed(_attached(reps, docs, id_col, text_col, n, threshold))))
    found = checkpointed(_verify(blocks, reps, docs, id_col, text_col, n, threshold, False))
    degree = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    linked = components(found.where("b is not null")).select(F.col("id").alias("rep"), "root")
    known = checkpointed(linked.join(degree, "rep", "full"))  # representatives with a partner only
    rows = members.join(maybe_broadcast(known), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked_rows, alone = rows.where("n_links > 0"), rows.where("n_links = 0")
    lowest = linked_rows.groupBy("root").agg(F.min("id").alias("class_id"))
    out = linked_rows.join(lowest, "root").select(F.col("id").alias("doc_id"), "class_id", "n_links")
    single = lambda x: x.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.union(single(alone)).union(single(empty))


def components(nodes_edges: DataFrame) -> DataFrame:
    """(id, root) of the nodes of the edges (a, b): the lowest id of each connected component, by alternating
    large-star and small-star steps (Kiveris et al. 2014). Lineage is cut after each round."""
    edges = checkpointed(nodes_edges.select("a", "b").where("a <> b").distinct())
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = small.groupBy("a").agg(F.min("b").alias("m"))
        small = small.join(low, "a").select("b", "m").where("b <> m").union(low).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = checkpointed(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        last = state


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, less near copies: of each group of documents that are linked by
    similar pairs, the one with the lowest id stays (of several texts with that id, one). What has no partners stays
    (see `links`), rows with a null id among it. Rows are removed by id and text, so other texts with the same
    id stay. Helper columns start with `__nd_`, so none clashes.

    Texts are first compared with the leads of their rare features, in a time linear in the size of a group. Only pairs that
    this and what follows from it leave in different components are then compared with each other. So a group of near
    copies costs one comparison each, and no link is lost.
    """
    members, _, reps = _classes(docs, id_col, text_col, n)
    attached = checkpointed(_attached(reps, docs, id_col, text_col, n, threshold))
    stars = checkpointed(_starred(attached, reps, docs, id_col, text_col, n, threshold).select("a", "b"))
    roots = components(stars)
    blocks = checkpointed(_blocks(attached, roots))
    if not blocks.isEmpty():
        more = checkpointed(_verify(blocks, reps, docs, id_col, text_col, n, threshold, False).where("b is not null").select("a", "b"))
        roots = components(stars.union(more)) if not more.isEmpty() else roots
    linked = roots.where("id <> root").select(F.col("id").alias("rep"), "root")
    rows = members.join(maybe_broadcast(linked), "rep", "left").select(F.struct("id", "t1", "t2").alias("key"), F.coalesce("root", "rep").alias("root"))
    first = rows.groupBy("root").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = rows.join(first, "root").where("key <> first").select(*(F.col(f"key.{c}").alias(f"__nd_{c}") for c in ("id", "t1", "t2")))
    t1, t2 = _digest(F.col(text_col))
    return docs.join(maybe_broadcast(checkpointed(gone)), (F.col(id_col).cast("bigint") == F.col("__nd_id")) & (t1 == F.col("__nd_t1")) & (t2 == F.col("__nd_t2")), "left_anti")
