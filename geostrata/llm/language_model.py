"""LM scoring: a smoothed byte n-gram model as a weighted automaton with failure arcs, one traversal of each text."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Bytes of an n-gram.
ORDER = 5
#: Least count, in the corpus, of the n-grams of each order that get an arc; what is rarer is reached by backing off.
MIN_COUNT = (1, 1, 2, 2, 2)
#: Bytes of text of a shard, on average, and shards to a bucket of contexts.
SHARD_BYTES = 16_000_000
SHARDS_PER_BUCKET = 4
#: Parts that one row of counts is divided into at most when it is sent on.
FANOUT = 64
#: Bytes that are counted at once, bytes of a lane, and lanes that are traversed side by side.
CHUNK, LANE, LANES = 2_000_000, 1024, 4096

#: What a shard gets of the model, as packed arrays.
PARTS = ("keys", "alpha", "weight", "bare", "bare_weight")
KINDS = (np.uint64, np.float32, np.float32, np.uint64, np.float32)

_TAG = np.uint64(40)  # a key is its order << 40 with its bytes, the last one lowest
_BYTES = np.uint64((1 << 40) - 1)
_B8 = np.uint64(8)


def ngram_counts(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all n-grams of orders 1 to `order` within the texts, and their counts."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held, size = [], 0
    for t in [*texts, None]:
        if t is not None:
            for a in range(0, max(1, len(t)), CHUNK):  # a stretch and the bytes that its last n-grams need
                held.append((t[a : a + CHUNK + order - 1], min(CHUNK, len(t) - a)))
                size += len(held[-1][0])
                if size >= CHUNK:
                    parts.append(_longest(held, order))
                    held, size = [], 0
        elif held:
            parts.append(_longest(held, order))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    long, count = _sum(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    valid, data = (long >> _TAG).astype(np.int64), long & _BYTES
    out = []
    for k in range(1, order + 1):
        use = valid >= k
        keys = (data[use] >> np.uint64(8 * (order - k))) | (np.uint64(k) << _TAG)
        out.append(_sum(keys, count[use]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _longest(held: list[tuple[bytes, int]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that start at the first bytes of each stretch, tagged with how much of them lies within the text."""
    pad = bytes(order - 1)
    raw = np.frombuffer(b"".join(t + pad for t, _ in held), np.uint8).astype(np.uint64)
    n = len(raw) - order + 1
    keys = np.zeros(n, np.uint64)
    for i in range(order):
        keys = (keys << _B8) | raw[i : n + i]
    sizes = np.array([len(t) for t, _ in held])
    starts = np.concatenate([[0], np.cumsum(sizes + order - 1)[:-1]])
    pos = np.arange(n) - np.repeat(starts, sizes + order - 1)[:n]
    length, use = np.repeat(sizes, sizes + order - 1)[:n], np.repeat([k for _, k in held], sizes + order - 1)[:n]
    valid = np.minimum(order, length - pos)
    keys |= np.maximum(valid, 0).astype(np.uint64) << _TAG
    return np.unique(keys[pos < use], return_counts=True)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def context(keys: np.ndarray) -> np.ndarray:
    """The key without its last byte."""
    return (((keys >> _TAG) - np.uint64(1)) << _TAG) | ((keys & _BYTES) >> _B8)


def shorter(keys: np.ndarray) -> np.ndarray:
    """The key without its first byte; that of the empty context stays."""
    k = (keys >> _TAG).astype(np.int64)
    less = np.maximum(k - 1, 0)
    mask = (np.uint64(1) << (less.astype(np.uint64) * _B8)) - np.uint64(1)
    return (less.astype(np.uint64) << _TAG) | (keys & mask)


def smooth(keys: np.ndarray, counts: np.ndarray, min_count: tuple[int, ...] = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept keys with alpha = c(hw) / (c(h) + T(h)) and the weight of backing off from h, from whole contexts' counts.

    Witten-Bell: T(h) is the number of kept continuations of h. The weight is 1 less the kept alphas, so what pruning
    removes goes to the shorter context and P(w|h) = alpha(hw) + weight(h) P(w|h') sums to 1 over the bytes w.
    """
    keep = counts >= np.array((0, *min_count))[(keys >> _TAG).astype(np.int64)]
    ctx = context(keys)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys, np.zeros(0), np.zeros(0)
    sizes = np.diff(np.append(first, len(keys)))
    total, kinds, kept = np.add.reduceat(counts, first), np.add.reduceat(keep.astype(np.int64), first), np.add.reduceat(counts * keep, first)
    denominator = np.repeat(total + kinds, sizes)
    weight = 1 - np.repeat(kept, sizes) / denominator
    return keys[keep], (counts / denominator)[keep], weight[keep]


class Automaton:
    """States are contexts with arcs; the arc of a byte carries log2 P and the next state, the failure arc of a state
    the log2 weight of backing off and the state of the context without its first byte.

    Arcs of a state lie together in the order of their bytes; a 256-bit map tells which there are and how many come
    before. So a step of many lanes is a handful of array operations, whatever the number of states.

    `bare` are contexts that have arcs in the whole model but none among `keys`, with their weights: they are states
    that can only be left by their failure arcs.
    """

    def __init__(self, keys: np.ndarray, alpha: np.ndarray, weight: np.ndarray, order: int = ORDER, bare: np.ndarray | None = None, bare_weight: np.ndarray | None = None):
        order_of = np.argsort(keys, kind="stable")
        keys, alpha, weight = keys[order_of], alpha[order_of].astype(np.float64), weight[order_of].astype(np.float64)
        self.order = order
        ctx = context(keys)
        every, weights = (ctx, weight) if bare is None else (np.concatenate([ctx, bare]), np.concatenate([weight, bare_weight.astype(np.float64)]))
        states, any_of = np.unique(every, return_index=True)
        first = np.searchsorted(ctx, states)
        owner = np.searchsorted(states, ctx)
        p = alpha.copy()
        level = (keys >> _TAG).astype(np.int64)
        p[level == 1] += weight[level == 1] / 256
        for k in range(2, order + 1):
            at = np.flatnonzero(level == k)
            p[at] += weight[at] * p[np.searchsorted(keys, shorter(keys[at]))]
        self.log_p, self.log_weight = np.log2(p), np.log2(weights[any_of])
        self.fail = np.searchsorted(states, shorter(states))
        target, self.next = np.where(level == order, shorter(keys), keys), np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = np.minimum(np.searchsorted(states, target[left]), len(states) - 1)
            hit = states[at] == target[left]
            self.next[left[hit]] = at[hit]
            left = left[~hit]
            target[left] = shorter(target[left])
        sym = keys & np.uint64(255)
        self.map = np.zeros((len(states), 4), np.uint64)
        np.bitwise_or.at(self.map, (owner, (sym >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (sym & np.uint64(63)))
        self.before = np.zeros((len(states), 4), np.int64)
        self.before[:, 1:] = np.cumsum(np.bitwise_count(self.map), axis=1)[:, :3]
        self.before += first[:, None]
        self.map, self.before = self.map.ravel(), self.before.ravel()

    def step(self, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next states, log2 probabilities and numbers of failure arcs taken of one byte on each lane."""
        word, bit = (sym >> 6).astype(np.int64), (sym & 63).astype(np.uint64)
        at = state * 4 + word
        have = self.map[at] >> bit
        hit = (have & np.uint64(1)).astype(bool)
        arc = self.before[at] + np.bitwise_count(self.map[at] & ((np.uint64(1) << bit) - np.uint64(1)))
        if hit.all():
            return self.next[arc], self.log_p[arc], np.zeros(len(state), np.int64)
        nxt, lp, fails = np.zeros(len(state), np.int64), np.zeros(len(state)), np.zeros(len(state), np.int64)
        nxt[hit], lp[hit] = self.next[arc[hit]], self.log_p[arc[hit]]
        miss = np.flatnonzero(~hit)
        root = miss[state[miss] == 0]
        lp[root] = self.log_weight[0] - 8  # a byte that no text has
        miss = miss[state[miss] != 0]
        if len(miss):
            n, p, f = self.step(self.fail[state[miss]], sym[miss])
            nxt[miss], lp[miss], fails[miss] = n, p + self.log_weight[state[miss]], f + 1
        return nxt, lp, fails

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability and number of failure arcs of each text, read from left to right from the empty context.

        A state depends on the last order - 1 bytes only. So a long text is cut into lanes that first read as many
        bytes before their own without counting them, and the result is that of one traversal.
        """
        warm = self.order - 1
        lanes = [(i, a, min(len(t), a + LANE)) for i, t in enumerate(texts) for a in range(0, len(t), LANE)]
        lanes.sort(key=lambda x: x[1] - x[2] - min(warm, x[1]))
        out, fails = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for k in range(0, len(lanes), LANES):
            group = lanes[k : k + LANES]
            skip = np.array([min(warm, a) for _, a, _ in group])
            size = np.array([b - a for _, a, b in group]) + skip
            flat = np.frombuffer(b"".join(texts[i][a - s : b] for (i, a, b), s in zip(group, skip.tolist())), np.uint8)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            state, total, back = np.zeros(len(group), np.int64), np.zeros(len(group)), np.zeros(len(group), np.int64)
            active = len(group)
            for t in range(int(size[0])):
                while size[active - 1] <= t:
                    active -= 1
                state[:active], lp, f = self.step(state[:active], flat[start[:active] + t])
                if t < warm:
                    lp, f = np.where(skip[:active] <= t, lp, 0), np.where(skip[:active] <= t, f, 0)
                total[:active] += lp
                back[:active] += f
            who = np.array([i for i, _, _ in group])
            np.add.at(out, who, total)
            np.add.at(fails, who, back)
        return out, fails


def _raw(texts: pa.ChunkedArray) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a key's context."""
    ctx = context(keys)
    with np.errstate(over="ignore"):
        h = (ctx ^ (ctx >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _packed(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    """Numbers and packed arrays of a step's rows."""
    kinds = {int: pa.int64(), bytes: pa.binary()}
    columns = list(zip(*rows))
    return pa.table({n: pa.array(c, kinds[type(c[0])]) for n, c in zip(names, columns)}) if rows else None


UP = "grp bigint, part bigint, child bigint, keys binary, counts binary"
DOWN = "grp bigint, part bigint, " + ", ".join(f"{c} binary" for c in PARTS)


def _divide(group: int, part: int, child: int, keys: np.ndarray, counts: np.ndarray, buckets: int, width: int, split: int) -> list[tuple]:
    """Rows of UP for the parts that part `part` of the buckets (`width` of them) is divided into by `split`."""
    at = _bucket(keys, buckets) // max(1, width // split)
    by = np.argsort(at, kind="stable")
    names, first = np.unique(at[by], return_index=True)
    return [(group, int(n), child, keys[c].tobytes(), counts[c].astype(np.int64).tobytes()) for n, c in zip(names, np.split(by, first[1:]))]


def _chosen(keys: np.ndarray, kept: np.ndarray, alpha: np.ndarray, weight: np.ndarray, contexts: np.ndarray, weights: np.ndarray) -> list[bytes]:
    """What of the smoothed model belongs to some keys: those that are kept, and the contexts that are left bare by them."""

    def there(of: np.ndarray, among: np.ndarray) -> np.ndarray:
        at = np.searchsorted(among, of)
        return at[among[np.minimum(at, len(among) - 1)] == of] if len(among) else at[:0]

    at = there(keys, kept)
    to = there(np.setdiff1d(context(keys), context(kept[at])), contexts)
    return [x.tobytes() for x in (kept[at], alpha[at], weight[at], contexts[to], weights[to])]


def _children(t: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(c, np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64)) for c, k, n in zip(t["child"].to_pylist(), t["keys"].to_pylist(), t["counts"].to_pylist())]


def steps(shards: int, fanout: int = FANOUT) -> tuple[int, int, int]:
    """Steps that counts go up, parts that each divides a part into (at most `fanout`), and groups that it merges."""
    wanted, levels = max(1, -(-shards // SHARDS_PER_BUCKET)), 1
    root = lambda n: next(r for r in itertools.count(max(1, math.floor(n ** (1 / levels)) - 1)) if r**levels >= n)
    while root(wanted) > fanout:
        levels += 1
    return levels, root(wanted), root(shards)


def _model(counted: DataFrame, shards: int, buckets: int, levels: int, split: int, group: int, min_count: tuple[int, ...]) -> DataFrame:
    """The part of the model (DOWN; grp is the shard) that each shard's texts can reach.

    Counts go up in `levels` steps. In each, `group` neighbouring groups of shards merge, and each part of the buckets is divided by
    `split`; a step reads and writes a bounded number of rows for each group and part, and there are about as many of these
    as shards at every step. At the top one row of tasks has all counts of a bucket and smooths them. What each group asked
    for goes down the same way. So rows are in proportion to the shards, and not to shards times buckets.
    """

    def merge(level: int):
        width, own = buckets // split**level, group

        def run(t: pa.Table) -> pa.Table:
            parts = _children(t)
            keys, counts = _sum(np.concatenate([k for _, k, _ in parts]), np.concatenate([n for _, _, n in parts]))
            g, part = t["grp"][0].as_py(), t["part"][0].as_py()
            return _packed(_divide(g // own, part, g, keys, counts, buckets, width, split), ("grp", "part", "child", "keys", "counts"))

        return run

    def smoothed(t: pa.Table) -> pa.Table:
        parts = _children(t)
        kept, alpha, weight = smooth(*_sum(np.concatenate([k for _, k, _ in parts]), np.concatenate([n for _, _, n in parts])), min_count)
        alpha, weight = alpha.astype(np.float32), weight.astype(np.float32)
        contexts, first = np.unique(context(kept), return_index=True)
        part = t["part"][0].as_py()
        return _packed([(c, part // split, *_chosen(k, kept, alpha, weight, contexts, weight[first])) for c, k, _ in parts], ("grp", "part", *PARTS))

    def hand_down(asked: pa.Table, model: pa.Table) -> pa.Table:
        if not asked.num_rows or not model.num_rows:
            return pa.table({n: pa.array([], pa.int64() if n in ("grp", "part") else pa.binary()) for n in ("grp", "part", *PARTS)})
        got = [np.frombuffer(b"".join(model[c].to_pylist()), kind) for c, kind in zip(PARTS, KINDS)]
        by, at = np.argsort(got[0], kind="stable"), np.argsort(got[3], kind="stable")
        kept, alpha, weight = (x[by] for x in got[:3])
        contexts, first = np.unique(np.concatenate([context(kept), got[3][at]]), return_index=True)
        weights = np.concatenate([weight, got[4][at]])[first]
        part = asked["part"][0].as_py()
        return _packed([(c, part // split, *_chosen(k, kept, alpha, weight, contexts, weights)) for c, k, _ in _children(asked)], ("grp", "part", *PARTS))

    asked = [counted]
    for level in range(1, levels):
        asked[-1] = checkpointed(asked[-1])
        asked.append(asked[-1].groupBy("grp", "part").applyInArrow(merge(level), UP))
    down = asked.pop().groupBy("grp", "part").applyInArrow(smoothed, DOWN)
    while asked:
        down = asked.pop().groupBy("grp", "part").cogroup(down.groupBy("grp", "part")).applyInArrow(hand_down, DOWN)
    return down


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: tuple[int, ...] = MIN_COUNT, shard_bytes: int = SHARD_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, log2_prob, bits_per_byte and backoffs (failure arcs taken).

    The model holds the n-grams of all texts, with counts over the whole corpus. It is never gathered in one place:
    rows are spread over shards of bounded size; each shard's distinct n-grams meet their contexts' totals in buckets
    and come back, smoothed, as that part of the automaton which the shard's texts can reach (see `_model`). So memory
    depends on the size of a shard, and what moves is proportional to the corpus.

    Null and empty texts have 0 bytes and null scores. Repeated rows count as often as they occur and are each
    answered, and they are spread over the shards like others; a null id stays null; other columns are ignored. An empty
    table gives an empty result. A row's place in its partition of `docs` has a part in its shard, so `docs` has to come from
    files or a checkpoint, not from a shuffle whose order changes when a lost task runs again.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    levels, split, group = steps(shards, fanout)
    buckets = split**levels
    cols = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    full = cols.where("text <> ''").select("id", "text", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("bigint").alias("grp"))

    def count(t: pa.Table) -> pa.Table:
        shard = t["grp"][0].as_py()
        return _packed(_divide(shard // group, 0, shard, *ngram_counts(_raw(t["text"]), order), buckets, buckets, split), ("grp", "part", "child", "keys", "counts"))

    def answer(t: pa.Table, model: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "log2_prob", "bits_per_byte", "backoffs"]
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], names=names)
        keys, alpha, weight, bare, bare_weight = (np.frombuffer(b"".join(model[c].to_pylist()), kind) for c, kind in zip(PARTS, KINDS))
        a = Automaton(keys, alpha, weight, order, bare, bare_weight)
        texts = _raw(t["text"])
        lp, fails = a.score(texts)
        n = np.array([len(x) for x in texts], np.int64)
        return pa.table([t["id"], pa.array(n), pa.array(lp), pa.array(-lp / n), pa.array(fails)], names=names)

    parts = _model(full.groupBy("grp").applyInArrow(count, UP), shards, buckets, levels, split, group, min_count)
    scored = full.groupBy("grp").cogroup(parts.groupBy("grp")).applyInArrow(answer, "doc_id bigint, n_bytes bigint, log2_prob double, bits_per_byte double, backoffs bigint")
    blank = cols.where("text is null or text = ''").selectExpr("id as doc_id", "0L as n_bytes", "cast(null as double) as log2_prob", "cast(null as double) as bits_per_byte", "0L as backoffs")
    return scored.unionByName(blank)
