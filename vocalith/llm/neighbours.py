"""Most similar vectors: a forest of hash-prefix trees.

Every tree hashes a direction to a long string: two learned symbols (the nearest of FAN centroids, then the nearest of FAN centroids
within that one, fitted on a bounded sample by a seed of the tree's own) and BITS_OF_STRING bits of half-spaces through the
last centroid. A tree is the sorted array of these strings, kept in parts by key range; the borders of the parts follow
the sample's strings and are drawn between leaves, or within a leaf that alone would fill a part. Equal vectors are one entry (a class).

A query descends each tree to its longest matching prefix and ascends in all trees alike until the ranges of rows that share its
prefix hold `meet` entries together. How many they hold is read from the sample's strings, which every task has, so that a query
goes straight to the parts its ranges lie in. With `meet` infinite it ascends to the root of each tree: the exact way.

Pairs above a cosine (`pairs`): every entry is a query, and none stops below its leaf. What lies in its ranges is compared by half-space bits
and what is near enough in these is verified on the vectors. A long run of one leaf is a small forest of its own: its bit strings
are sorted from several places on, and entries that share a chunk there are compared (`compare_run`).

Nearest neighbours of stated queries (`nearest`): the rows in a query's ranges are scored in blocks; vectors travel with 16 bits
a dimension, so that cosines are right to about 1e-5.

Defined results: a vector is usable if it is not null, of the stated length, free of NaN and infinite values and not all zero;
rows without id or usable vector have no neighbours; a repeated row counts once; equal vectors have cosine 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import bloom

DIMS = 64
FAN = 64  # centroids of a learned symbol
SAMPLE = 32_768  # rows of a field that centroids, ranges and borders are fitted on; every row is indexed
BITS = 192  # of half-spaces that entries are compared by
BITS_OF_STRING = 48
DEPTHS = (0, 6, 12, *range(16, 61, 4))  # bits of the prefixes of a string, by depth
LEAF = 2  # depth of the learned symbols
TREES = 7  # of pairs: a pair of cosine 0.92 shares a leaf in half of the trees, one of 0.98 in three quarters
MEET = 64  # entries in which an ascent of pairs ends
RUN = 4096  # entries of one leaf that are compared whole
CHUNK = 12  # bits by which a longer run is cut
TASK = 1 << 16  # entries of a part, about
SEED = 20240229
FLUSH = 64 << 20


def usable(col: pa.ListArray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of the usable vectors of a list column, their directions)."""
    n = np.diff(col.offsets.to_numpy())
    n[np.asarray(col.is_null())] = 0
    right = np.nonzero(n == dims)[0]
    if not len(right):
        return right, np.zeros((0, dims), np.float32)
    part = col.take(pa.array(right)) if len(right) < len(col) else col
    v = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norm = np.sqrt((v * v).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return right[good], (v[good] / norm[good, None]).astype(np.float32)


def sketch(projected: np.ndarray) -> np.ndarray:
    return np.packbits(projected > 0, axis=1).view(np.uint64)


def planes() -> np.ndarray:
    return np.random.default_rng(SEED + 1).standard_normal((DIMS, BITS)).astype(np.float32)


# ---- a tree's strings


def centroids(x: np.ndarray, rng: np.random.Generator, k: int = FAN, rounds: int = 4) -> np.ndarray:
    """k directions in the middle of those of x; with fewer rows the first stands in for what is lacking."""
    if not len(x):
        return np.zeros((k, DIMS), np.float32)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        one = np.zeros((len(x), len(c)), np.float32)
        one[np.arange(len(x)), (x @ c.T).argmax(1)] = 1
        s = one.T @ x
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, s / np.maximum(norm, 1e-6), c).astype(np.float32)
    return np.concatenate([c, np.repeat(c[:1], k - len(c), 0)])


class Tree:
    """Hashes directions to strings of 64 bits, the first symbol highest."""

    def __init__(self, sample: np.ndarray, number: int) -> None:
        rng = np.random.default_rng([SEED, number])
        self.first = centroids(sample[rng.permutation(len(sample))[: SAMPLE // 4]], rng)
        at = (sample @ self.first.T).argmax(1)
        self.second = np.stack([centroids(sample[at == j], rng) for j in range(FAN)])
        self.at = np.arange(number * 29, number * 29 + BITS_OF_STRING) % BITS  # the half-spaces of its strings

    @cached_property
    def middles(self) -> np.ndarray:
        return self.second.reshape(-1, DIMS) @ planes()[:, self.at]

    def strings(self, u: np.ndarray, projected: np.ndarray) -> np.ndarray:
        """projected: u by all half-spaces."""
        one = (u @ self.first.T).argmax(1)
        two = np.zeros(len(u), np.int64)
        order = np.argsort(one, kind="stable")
        edge = np.concatenate([np.searchsorted(one[order], np.arange(FAN)), [len(u)]])
        for j in np.unique(one):
            k = order[edge[j] : edge[j + 1]]
            two[k] = (u[k] @ self.second[j].T).argmax(1)
        leaf = one * FAN + two
        bits = np.packbits(projected[:, self.at] > self.middles[leaf], axis=1)
        low = np.zeros(len(u), np.uint64)
        for j in range(bits.shape[1]):
            low = (low << np.uint64(8)) | bits[:, j].astype(np.uint64)
        return (leaf.astype(np.uint64) << np.uint64(52)) | (low << np.uint64(4))


def ends(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest string that share the prefix of that depth."""
    mask = np.uint64((1 << (64 - DEPTHS[depth])) - 1)
    return key & ~mask, key | mask


class Forest:
    """The trees of one field, the sample's strings and the borders of the parts."""

    def __init__(self, sample: np.ndarray, trees: int, n: int, seed: int = 0) -> None:
        self.trees = [Tree(sample, seed + t) for t in range(trees)]
        self.scale = n / max(1, len(sample))
        projected = sample @ planes()
        self.sorted = [np.sort(t.strings(sample, projected)) for t in self.trees]
        self.borders = [self._borders(s, n) for s in self.sorted]
        self.offsets = np.concatenate([[0], np.cumsum([len(b) + 1 for b in self.borders])])  # of the parts of each tree

    def _borders(self, keys: np.ndarray, n: int) -> np.ndarray:
        parts = -(-n // TASK)
        at = keys[np.arange(1, parts) * len(keys) // parts] if len(keys) else keys
        out = at.copy()
        left = np.ones(len(at), bool)
        for depth in range(LEAF, len(DEPTHS)):
            lo, hi = ends(at, depth)
            fits = left & (((np.searchsorted(keys, hi, "right") - np.searchsorted(keys, lo)) * self.scale <= TASK) | (depth == len(DEPTHS) - 1))
            out[fits] = lo[fits]
            left &= ~fits
        return np.unique(out)

    def part(self, t: int, key: np.ndarray) -> np.ndarray:
        return self.offsets[t] + np.searchsorted(self.borders[t], key, "right")

    def stops(self, keys: np.ndarray, meet: float, deepest: int = len(DEPTHS) - 1) -> np.ndarray:
        """keys(n, trees) -> the depth at which the ascent of each query ends: the greatest at which its ranges hold meet entries."""
        out = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for depth in range(deepest, 0, -1):
            if not len(open_):
                break
            held = np.zeros(len(open_))
            for t, s in enumerate(self.sorted):
                lo, hi = ends(keys[open_, t], depth)
                held += (np.searchsorted(s, hi, "right") - np.searchsorted(s, lo)) * self.scale
            enough = held >= meet
            out[open_[enough]] = depth
            open_ = open_[~enough]
        return out


def _fields(rows: DataFrame, row_id: str, fields: dict[str, str], *more) -> DataFrame:  # noqa: ANN002
    """The rows as they go to the hashing: id, then for each field cls and vector, then further columns."""
    cols = [c for i, (k, v) in enumerate(fields.items()) for c in (F.xxhash64(F.lit(k), F.col(v)).alias(f"c{i}"), F.col(v).cast("array<float>").alias(f"v{i}"))]
    return rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), *cols, *more)


def plant(rows: DataFrame, row_id: str, fields: dict[str, str], trees: int, sample: int = SAMPLE) -> list[Forest]:
    """A forest for each field, fitted on about `sample` rows chosen by a hash of the id."""
    n = rows.count()
    h = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    picked = _fields(rows, row_id, fields).where(h < sample / max(1, n))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(fields)):
                _, u = usable(b.column(2 + 2 * i))
                if len(u):
                    yield pa.record_batch([pa.array([i], pa.int32()), pa.array([u.tobytes()], pa.binary())], ["f", "blob"])

    got: list[list[bytes]] = [[] for _ in fields]
    for r in picked.mapInArrow(take, "f int, blob binary").collect():  # about `sample` vectors a field
        got[r["f"]].append(bytes(r["blob"]))
    out = []
    for i, x in enumerate(got):
        u = np.frombuffer(b"".join(x), np.float32).reshape(-1, DIMS)
        out.append(Forest(u[np.lexsort(u.T[:4])], trees, n, 100 * i))
    return out


def slots(forests: list[Forest]) -> np.ndarray:
    """Where the parts of each forest begin among those of all."""
    return np.concatenate([[0], np.cumsum([f.offsets[-1] for f in forests])]).astype(np.int64)


def _blobs(slot: np.ndarray, e: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Entries by the part they go to."""
    order = np.argsort(slot, kind="stable")
    u, at = np.unique(slot[order], return_index=True)
    blobs = [x.tobytes() for x in np.split(e[order], at[1:])] if len(u) else []
    return pa.record_batch([pa.array(u.astype(np.int32)), pa.array(np.full(len(u), kind, np.int8)), pa.array(blobs, pa.binary())], ["slot", "kind", "blob"])


def _reach(forest: Forest, t: int, key: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, part) for each part of tree t that a query's range at its depth lies in."""
    lo, hi = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for d in np.unique(depth):
        m = depth == d
        a, b = ends(key[m], d)
        lo[m], hi[m] = forest.part(t, a), forest.part(t, b)
    n = hi - lo + 1
    who = np.repeat(np.arange(len(key)), n)
    return who, lo[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)


def _ranges(keys: np.ndarray, key: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a sorted array that share each query's prefix of its depth."""
    lo, hi = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for d in np.unique(depth):
        m = depth == d
        a, b = ends(key[m], d)
        lo[m], hi[m] = np.searchsorted(keys, a), np.searchsorted(keys, b, "right")
    return lo, hi


# ---- pairs above a cosine

ENTRY = np.dtype([("key", np.uint64), ("cls", np.int64), ("bits", np.uint64, BITS // 64)])  # the last four bits of key hold the depth of its stop


def vectors(rows: DataFrame, row_id: str, fields: dict[str, str]) -> DataFrame:
    """(id, field, cls, vec): one row per row and field; equal vectors of a field have equal cls."""
    pick = [F.struct(F.lit(k).alias("field"), F.xxhash64(F.lit(k), F.col(c)).alias("cls"), F.col(c).cast("array<float>").alias("vec")) for k, c in fields.items()]
    return rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.explode(F.array(*pick)).alias("x")).select("id", "x.*").where(F.size("vec") == DIMS)


Found = tuple[list[np.ndarray], list[np.ndarray]]


def _steps(end: np.ndarray, cls: np.ndarray, bits: np.ndarray, most: int, found: Found) -> None:
    """Pairs of a sorted array within runs: each entry with those after it, up to end."""
    act, step = np.arange(len(end)), 1
    while True:
        act = act[act + step < end[act]]
        if not len(act):
            return
        d = np.zeros(len(act), np.uint16)
        for x in bits:
            d += np.bitwise_count(x[act] ^ x[act + step])
        hit = act[d <= most]
        if len(hit):
            found[0].append(cls[hit]), found[1].append(cls[hit + step])
        step += 1


def compare_run(cls: np.ndarray, bits: np.ndarray, most: int, found: Found, run: int = RUN, at: int = 0) -> None:
    """Pairs of a run of entries of one leaf. A long run is cut by each chunk of the bits in turn, so that two entries meet if any chunk
    of CHUNK bits agrees: at cosine 0.92 in all but three of a hundred pairs, which other trees may still find."""
    if len(cls) <= run or at >= 3:
        _steps(np.full(len(cls), len(cls)), cls, bits, most, found)
        return
    for c in range(BITS // CHUNK):
        c = (c + at) % (BITS // CHUNK) if at else c
        lo = c * CHUNK
        word, shift = lo // 64, 64 - lo % 64 - CHUNK
        part = (bits[word] << np.uint64(-shift) | bits[word + 1] >> np.uint64(64 + shift) if shift < 0 else bits[word] >> np.uint64(shift)) & np.uint64((1 << CHUNK) - 1)
        order = np.argsort(part, kind="stable")
        p = part[order]
        cuts = np.concatenate([[0], np.nonzero(p[1:] != p[:-1])[0] + 1, [len(p)]])
        size = np.diff(cuts)
        end = np.repeat(np.where(size > run, cuts[:-1], cuts[1:]), size)
        _steps(end, cls[order], np.ascontiguousarray(bits[:, order]), most, found)
        for k in np.nonzero(size > run)[0]:
            o = order[cuts[k] : cuts[k + 1]]
            compare_run(cls[o], np.ascontiguousarray(bits[:, o]), most, found, run, at + 1 + c % 2)


def pairs_within(mine: np.ndarray, asked: np.ndarray, most: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes of a part: its entries, and queries that come from other parts, each with what shares its prefix."""
    e = mine[np.lexsort((mine["cls"], mine["key"]))]
    if len(e):
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["key"][1:] != e["key"][:-1]) | (e["cls"][1:] != e["cls"][:-1])
        e = e[fresh]
    cls, bits = np.ascontiguousarray(e["cls"]), np.ascontiguousarray(e["bits"].T)
    found: Found = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    # leaves: every entry of a leaf is in the range of the others
    leaf = e["key"] >> np.uint64(64 - DEPTHS[LEAF])
    end = np.searchsorted(leaf, leaf, "right")
    start = np.searchsorted(leaf, leaf)
    long = end - start > run
    _steps(np.where(long, 0, end), cls, bits, most, found)
    for a in np.unique(start[long]):
        b = end[a]
        compare_run(cls[a:b], np.ascontiguousarray(bits[:, a:b]), most, found, run)
    # queries that ascended above their leaf, or came from another part
    own = e[(e["key"] & np.uint64(15)) < LEAF]
    q = np.concatenate([own, asked])
    if len(q) and len(e):
        depth = (q["key"] & np.uint64(15)).astype(np.int64)
        lo, hi = _ranges(e["key"], q["key"], depth)
        order = np.lexsort((hi, lo))
        q, lo, hi = q[order], lo[order], hi[order]
        cuts = np.concatenate([[0], np.nonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[0] + 1, [len(q)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            x, y = int(lo[a]), int(hi[a])
            for k in range(a, b, max(1, (1 << 21) // max(1, y - x))):
                w = q[k : min(b, k + max(1, (1 << 21) // max(1, y - x)))]
                d = np.zeros((len(w), y - x), np.uint16)
                for j in range(BITS // 64):
                    d += np.bitwise_count(w["bits"][:, j, None] ^ bits[j][None, x:y])
                i, j = np.nonzero(d <= most)
                found[0].append(w["cls"][i]), found[1].append(cls[x + j])
    a, b = np.concatenate(found[0]), np.concatenate(found[1])
    p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    return p[:, 0], p[:, 1]


def bits_of(least: float) -> int:
    """The most bits in which two directions of at least that cosine differ, but for about one pair in a thousand of just that cosine."""
    p = 1 - math.acos(least) / math.pi
    return math.floor(BITS * (1 - p) + 3.1 * math.sqrt(BITS * p * (1 - p)))


def candidates(rows: DataFrame, row_id: str, fields: dict[str, str], least: float, trees: int = TREES, meet: float = MEET) -> DataFrame:
    """(a, b): the pairs of classes, a < b, that meet in the forest and whose bits agree with a cosine of least."""
    forests = plant(rows, row_id, fields, trees)
    base, n_parts = slots(forests), int(slots(forests)[-1])
    held = rows.sparkSession.sparkContext.broadcast(forests)  # of a bounded sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        woods, half = held.value, planes()
        seen: list[set[int]] = [set() for _ in woods]
        waiting: tuple[list, list] = ([], [])
        asking: tuple[list, list] = ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, (slot, e) in enumerate((waiting, asking)):
                if slot:
                    yield _blobs(np.concatenate(slot), np.concatenate(e), kind)
                    slot.clear(), e.clear()

        for batch in batches:
            for i, forest in enumerate(woods):
                cls = batch.column(1 + 2 * i).to_numpy(zero_copy_only=False)
                at, u = usable(batch.column(2 + 2 * i))
                _, first = np.unique(cls[at], return_index=True)
                new = np.array([k for k in first.tolist() if int(cls[at[k]]) not in seen[i]], np.int64)
                seen[i].update(cls[at[new]].tolist())
                if len(seen[i]) > 250_000:
                    seen[i].clear()
                for lo in range(0, len(new), 8192):
                    k = new[lo : lo + 8192]
                    projected = u[k] @ half
                    keys = np.stack([t.strings(u[k], projected) for t in forest.trees], 1)
                    stop = forest.stops(keys, meet, LEAF)
                    e = np.empty(len(k), ENTRY)
                    e["cls"], e["bits"] = cls[at[k]], sketch(projected)
                    for t in range(len(forest.trees)):
                        key = keys[:, t]
                        e["key"] = key | stop.astype(np.uint64)
                        mine = forest.part(t, key)
                        waiting[0].append(base[i] + mine), waiting[1].append(e.copy())
                        who, part = _reach(forest, t, key, stop)
                        away = part != mine[who]
                        if away.any():
                            asking[0].append(base[i] + part[away]), asking[1].append(e[who[away]])
            if sum(x.nbytes for x in waiting[1]) > FLUSH:
                yield from flush()
        yield from flush()

    most = bits_of(least)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[list, list]] = {}
        for b in batches:
            for s, kind, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts.setdefault(s, ([], []))[kind].append(np.frombuffer(x, ENTRY))
        none = [np.zeros(0, ENTRY)]
        for mine, asked in parts.values():
            a, b = pairs_within(np.concatenate(mine or none), np.concatenate(asked or none), most)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    planted = _fields(rows, row_id, fields).mapInArrow(index, "slot int, kind byte, blob binary")
    return planted.repartitionById(n_parts, F.col("slot")).mapInArrow(search, "a long, b long").distinct()


def pairs(rows: DataFrame, row_id: str, fields: dict[str, str], least: float, trees: int = TREES, meet: float = MEET) -> tuple[DataFrame, DataFrame]:
    """(classes (a, b, cosine) of cosine at least `least`, a < b; members (id, field, cls) of all usable classes)."""
    spark = rows.sparkSession
    cand = cut(candidates(rows, row_id, fields, least, trees, meet))
    needed = cand.select(F.col("a").alias("cls")).union(cand.select(F.col("b").alias("cls")))
    may = bloom.contains(spark, bloom.build(needed, "cls"))
    v = vectors(rows, row_id, fields)
    vecs = v.select("cls", "vec").where(may("cls")).dropDuplicates(["cls"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    x = cand.join(vecs.select(F.col("cls").alias("a"), F.col("vec").alias("x")), "a").join(vecs.select(F.col("cls").alias("b"), F.col("vec").alias("y")), "b")
    cosine = F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")))
    good = ~F.exists("vec", lambda t: t.isNull() | F.isnan(t) | (F.abs(t) == float("inf"))) & F.exists("vec", lambda t: t != 0)
    members = v.where(good).select("id", "field", "cls")
    return x.select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= least), members


def row_pairs(rows: DataFrame, row_id: str, fields: dict[str, str], least: float, trees: int = TREES, meet: float = MEET) -> DataFrame:
    """(field, a, b): all pairs of rows, a < b, whose vectors have at least that cosine."""
    close, members = pairs(rows, row_id, fields, least, trees, meet)
    members = members.distinct()
    left = members.select(F.col("cls").alias("a"), F.col("id").alias("ia"), "field")
    right = members.select(F.col("cls").alias("b"), F.col("id").alias("ib"))
    between = close.join(left, "a").join(right, "b").select("field", "ia", "ib")
    many = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cls").alias("a"))
    mine = left.join(many, "a")
    within = mine.join(mine.select("a", F.col("ia").alias("ib")), "a").where("ia < ib").select("field", "ia", "ib")
    return between.unionByName(within).select("field", F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


# ---- nearest neighbours of stated queries

QUERY_TREES = 2
QUERY_MEET = 8192  # entries in which the ascent of a query ends; infinite for the exact way


def nearest(rows: DataFrame, row_id: str, fields: dict[str, str], query: str, k: int = 10, trees: int = QUERY_TREES, meet: float = QUERY_MEET) -> DataFrame:
    """(field, id, neighbour, cosine, place): the k rows most like each row for which the SQL condition query holds."""
    names = list(fields)
    forests = plant(rows, row_id, fields, trees)
    base, n_parts = slots(forests), int(slots(forests)[-1])
    held = rows.sparkSession.sparkContext.broadcast(forests)  # of a bounded sample
    # the last four bits of key hold the depth at which a query stops
    entry = np.dtype([("key", np.uint64), ("id", np.int64), ("scale", np.float32), ("v", np.int16, DIMS)])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        woods, half = held.value, planes()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ask = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            for i, forest in enumerate(woods):
                at, u = usable(batch.column(2 + 2 * i))
                if not len(at):
                    continue
                projected = u @ half
                keys = np.stack([t.strings(u, projected) for t in forest.trees], 1)
                e = np.empty(len(at), entry)
                e["id"], e["scale"] = ids[at], np.abs(u).max(1) / 32767
                e["v"] = np.round(u / e["scale"][:, None])
                q = np.nonzero(ask[at])[0]
                stop = forest.stops(keys[q], meet)
                for t in range(len(forest.trees)):
                    e["key"] = keys[:, t]
                    yield _blobs(base[i] + forest.part(t, keys[:, t]), e, 0)
                    if len(q):
                        who, part = _reach(forest, t, keys[q, t], stop)
                        x = e[q[who]]
                        x["key"] |= stop[who].astype(np.uint64)
                        yield _blobs(base[i] + part, x, 1)

    def best(f: np.ndarray, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple:
        """The k best of each query so far, each neighbour once."""
        order = np.lexsort((j, -c, i, f))
        f, i, j, c = f[order], i[order], j[order], c[order]
        new = np.ones(len(i), bool)
        new[1:] = (f[1:] != f[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        f, i, j, c = f[new], i[new], j[new], c[new]
        fresh = np.ones(len(i), bool)
        fresh[1:] = (f[1:] != f[:-1]) | (i[1:] != i[:-1])
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))
        keep = rank < k
        return f[keep], i[keep], j[keep], c[keep]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[list, list]] = {}
        for b in batches:
            for s, kind, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts.setdefault(s, ([], []))[kind].append(np.frombuffer(x, entry))
        for s, (mine, asked) in parts.items():
            if not mine or not asked:
                continue
            r, q = np.concatenate(mine), np.concatenate(asked)
            r = r[np.unique(r["id"], return_index=True)[1]]
            r = r[np.argsort(r["key"], kind="stable")]
            q = q[np.unique(q["id"], return_index=True)[1]]
            lo, hi = _ranges(r["key"], q["key"], (q["key"] & np.uint64(15)).astype(np.int64))
            order = np.lexsort((hi, lo))
            q, lo, hi = q[order], lo[order], hi[order]
            v = r["v"].astype(np.float32) * r["scale"][:, None]
            field = int(np.searchsorted(base, s, "right")) - 1
            found: list[tuple] = []
            cuts = np.concatenate([[0], np.nonzero((lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[0] + 1, [len(q)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                x, y = int(lo[a]), int(hi[a])
                if x == y:
                    continue
                for p in range(a, b, 256):
                    w = q[p : min(b, p + 256)]
                    sim = (w["v"].astype(np.float32) * w["scale"][:, None]) @ v[x:y].T
                    sim[w["id"][:, None] == r["id"][None, x:y]] = -2
                    m = min(k, y - x)
                    top = np.argpartition(-sim, m - 1, 1)[:, :m]
                    val = np.take_along_axis(sim, top, 1)
                    ok = val > -2
                    i = np.repeat(w["id"], m)[ok.ravel()]
                    found.append((np.full(len(i), field, np.int32), i, r["id"][x + top][ok], np.round(val[ok].astype(np.float64), 4)))
            if found:
                f, i, j, c = best(*(np.concatenate(x) for x in zip(*found)))
                yield pa.record_batch([pa.array(f.astype(np.int32)), pa.array(i), pa.array(j), pa.array(c)], ["f", "id", "neighbour", "cosine"])

    planted = _fields(rows, row_id, fields, F.coalesce(F.expr(query), F.lit(False)).alias("ask")).mapInArrow(index, "slot int, kind byte, blob binary")
    scored = planted.repartitionById(n_parts, F.col("slot")).mapInArrow(search, "f int, id long, neighbour long, cosine double")
    # at most k a query and part: the lists of a query are bounded by the parts its ranges lie in
    top = scored.groupBy("f", "id", "neighbour").agg(F.max("cosine").alias("cosine")).groupBy("f", "id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "neighbour"))), 1, k).alias("near"))
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("f") + 1)
    return top.select(label.alias("field"), "id", F.posexplode("near").alias("place", "x")).select("field", "id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.minus")).alias("cosine"), (F.col("place") + 1).alias("place"))
