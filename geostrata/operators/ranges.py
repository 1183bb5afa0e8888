"""How many points each of many rectangles holds, and their most frequent terms, without meeting rectangle by point.

Points are put in order once (a wavelet matrix: by latitude, with the ranks of the longitudes bit by bit), then each
rectangle takes a number of steps that grows with the logarithm of the points. This runs in Python workers on numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: So few points are compared with the rectangles one by one.
FEW_POINTS = 12
#: Counts of terms that are held at once while the most frequent ones are looked for.
HELD = 1 << 22


@dataclass
class Rects:
    """Rectangles of queries; those that are `anywhere` hold points without a place too."""

    ids: np.ndarray
    lat_from: np.ndarray
    lon_from: np.ndarray
    lat_to: np.ndarray
    lon_to: np.ndarray
    closed: np.ndarray
    anywhere: np.ndarray
    k: np.ndarray

    def take(self, which) -> Rects:
        return Rects(*(getattr(self, x)[which] for x in self.__dataclass_fields__))


def rects(table: pa.Table) -> Rects:
    """Of a table query_id, lat_from, lon_from, lat_to, lon_to, closed, k. A null in place of a corner but the first holds nothing."""
    column = lambda x, null: table[x].combine_chunks().fill_null(null).to_numpy(zero_copy_only=False)
    anywhere = table["lat_from"].is_null().to_numpy()
    whole = anywhere.copy()
    at = ("lat_from", "lon_from", "lat_to", "lon_to")
    whole |= ~np.any([table[x].is_null().to_numpy() for x in at], 0)
    return Rects(column("query_id", 0), *(column(x, 0.0) for x in at), column("closed", False), anywhere, column("k", 0)).take(whole)


def count(lat: np.ndarray, lon: np.ndarray, r: Rects) -> np.ndarray:
    """The points in each rectangle. As in Spark, NaN is greater than any number and equals itself."""
    n, many = len(lat), len(r.ids)
    total = np.zeros(many, np.int64)
    if n <= FEW_POINTS:
        below = lambda x, top: ~_greater(x, top) & (r.closed | _greater(top, x))
        for x, y in zip(lat, lon):
            total += ~_greater(r.lat_from, x) & below(x, r.lat_to) & ~_greater(r.lon_from, y) & below(y, r.lon_to)
        return total
    order = np.argsort(lat, kind="stable")
    lat, lon = lat[order], lon[order]
    by_lon = np.argsort(lon, kind="stable")
    rank = np.empty(n, np.int32)
    rank[by_lon] = np.arange(n, dtype=np.int32)
    lon = lon[by_lon]
    upper = lambda held, top: np.where(r.closed, np.searchsorted(held, top, "right"), np.searchsorted(held, top, "left"))
    first, last = np.searchsorted(lat, r.lat_from), upper(lat, r.lat_to)
    west, east = np.searchsorted(lon, r.lon_from), upper(lon, r.lon_to)
    some = np.flatnonzero((first < last) & (west < east))
    if len(some):
        both = lambda a, b: np.concatenate([a[some], b[some]]).astype(np.int32)
        found = _below(rank, both(first, first), both(last, last), both(east, west))
        total[some] = found[: len(some)] - found[len(some) :]
    return total


def _greater(a, b):
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _below(rank: np.ndarray, first: np.ndarray, last: np.ndarray, top: np.ndarray) -> np.ndarray:
    """How many of rank[first:last] are less than top, for each of many first, last and top. Changes its arguments."""
    found = np.zeros(len(first), np.int32)
    zeros = np.zeros(len(rank) + 1, np.int32)
    for b in reversed(range(len(rank).bit_length())):
        one = (rank >> b & 1).astype(bool)
        np.cumsum(~one, out=zeros[1:], dtype=np.int32)
        rank = np.concatenate([rank[~one], rank[one]])
        go = (top >> b & 1).astype(bool)
        a, z = zeros[first], zeros[last]
        found += np.where(go, z - a, 0)
        first = np.where(go, first - a + zeros[-1], a)
        last = np.where(go, last - z + zeros[-1], z)
    return found


def _points(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lat, lon, whether both are there)."""
    lat, lon = (rows[x].combine_chunks() for x in ("lat", "lon"))
    there = ~(lat.is_null().to_numpy(zero_copy_only=False) | lon.is_null().to_numpy(zero_copy_only=False))
    return *(x.fill_null(0.0).to_numpy(zero_copy_only=False) for x in (lat, lon)), there


def _held(lat: np.ndarray, lon: np.ndarray, there: np.ndarray, r: Rects) -> np.ndarray:
    return np.where(r.anywhere, len(lat), count(lat[there], lon[there], r) if not r.anywhere.all() else 0)


def counts(rows: pa.Table, key: str | None, r: Rects) -> pa.Table:
    """(query_id, key, cnt) of the points of one key, for the rectangles that hold some."""
    found = _held(*_points(rows), r)
    at = np.flatnonzero(found)
    return pa.table({"query_id": r.ids[at], "key": pa.repeat(pa.scalar(key, pa.string()), len(at)), "cnt": found[at].astype(np.int64)})


def words(rows: pa.Table, key: str | None, r: Rects, cut: bool) -> pa.Table:
    """(query_id, k, key, term, freq, rnk) of the points of one key and their `tags`: the most frequent k of each
    rectangle, of equal ones the first by their bytes; or all, where `cut` is off, with rnk 0."""
    lat, lon, there = _points(rows)
    tags = rows["tags"].combine_chunks()
    of = np.repeat(np.arange(len(tags)), tags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    coded = tags.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
    names += [None] * bool(coded.null_count)
    sorted_names = sorted(range(len(names)), key=lambda i: (names[i] is not None, (names[i] or "").encode()))  # nulls first, as Spark's ascending order
    place = np.empty(len(names), np.int64)
    place[sorted_names] = np.arange(len(names))
    names = [names[i] for i in sorted_names]
    codes = place[codes] if len(codes) else codes.astype(np.int64)
    order = np.argsort(codes, kind="stable")
    of, ends = of[order], np.searchsorted(codes[order], np.arange(len(names) + 1))
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, HELD // max(1, len(names)))
    for begin in range(0, len(r.ids), step):
        part = r.take(slice(begin, begin + step))
        freq = np.zeros((len(names), len(part.ids)), np.int64)
        for t in range(len(names)):
            own = of[ends[t] : ends[t + 1]]
            freq[t] = _held(lat[own], lon[own], there[own], part)
        if not cut:
            t, q = np.nonzero(freq)
            out.append((part.ids[q], part.k[q], t, freq[t, q], np.zeros(len(q), np.int32)))
            continue
        best = np.argsort(-freq, axis=0, kind="stable")[: max(0, part.k.max(initial=0))]  # stable, and terms are in order
        for i, t in enumerate(best):
            q = np.flatnonzero((part.k > i) & (freq[t, np.arange(len(part.ids))] > 0))
            out.append((part.ids[q], part.k[q], t[q], freq[t[q], q], np.full(len(q), i + 1, np.int32)))
    ids, k, t, f, rnk = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5
    terms = pa.DictionaryArray.from_arrays(pa.array(t, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
    return pa.table({"query_id": pa.array(ids, pa.int64()), "k": pa.array(k, pa.int32()), "key": pa.repeat(pa.scalar(key, pa.string()), len(ids)), "term": terms, "freq": pa.array(f, pa.int64()), "rnk": pa.array(rnk, pa.int32())})
