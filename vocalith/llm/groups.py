"""Grouping records into clusters of like ones: Gaussian mixtures per source, by expectation-maximisation over all rows.

Directions are standardised and reduced to their first COMPONENTS principal components, from moments summed over all rows of a
source. A bounded sample of each source (SAMPLE rows by a hash of the id) only gives starting points; from there every pass of
expectation-maximisation is over all rows, and only sums per source leave the tasks. Variances are diagonal, drawn a little to
their mean and kept off zero. The number of groups is the one with the least Bayesian information criterion over all rows; numbers
are tried GROUPS_AT_ONCE at a time, and more as long as the largest one tried is the best.
The rows of highest density stand for a group.

Defined results: a row counts once by its id; rows without source, id or usable vector are in no group; a source of one row is one
group; equal rows fall into the same group; a feature that never varies counts for nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from .neighbours import DIMS, usable

COMPONENTS = 12
GROUPS_AT_ONCE = 12
SAMPLE = 1500
FLOOR = 0.02  # least variance, as a share of the mean variance of the source's components
SHRINK = 0.1  # of each variance towards the group's mean variance
PASSES = 60  # a guard: passes end where the likelihood settles
CLOSE = 1e-4  # relative change of the likelihood at which passes end


def directions(rows: DataFrame) -> DataFrame:
    """rows(row_id, source, cluster_id, vec) -> (row_id, source, cluster_id, u): each usable row once, as a direction."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, u = usable(b.column(3))
            take = pa.array(at)
            u = pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), DIMS).cast(pa.list_(pa.float32()))
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), u], ["row_id", "source", "cluster_id", "u"])

    base = rows.select(F.col("row_id").cast("long").alias("row_id"), "source", F.col("cluster_id").cast("int").alias("cluster_id"), F.col("vec").cast("array<float>").alias("vec"))
    base = base.where("row_id is not null and source is not null and vec is not null").dropDuplicates(["row_id"])
    return base.mapInArrow(turn, "row_id long, source string, cluster_id int, u array<float>")


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(parts: DataFrame) -> dict[tuple, list[np.ndarray]]:
    """parts(source, k, blob): the sums of the pickled arrays of each (source, k); a row per source and k reaches the driver."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for blob in pdf["blob"]:
            x = pickle.loads(blob)
            total = x if total is None else [p + q for p, q in zip(total, x)]
        return pd.DataFrame({"source": [key[0]], "k": [key[1]], "blob": [pickle.dumps(total)]})

    got = parts.groupBy("source", "k").applyInPandas(add, "source string, k int, blob binary").collect()
    return {(r["source"], r["k"]): pickle.loads(r["blob"]) for r in got}


def _sums_of(df: DataFrame, per_source, columns: list[str]) -> dict[tuple, list[np.ndarray]]:  # noqa: ANN001
    """Sums over all rows: per_source(source, arrow batch of its rows) -> {k: arrays}, added up within each task first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for b in batches:
            names = b.column(0).to_pylist()
            where: dict[str, list[int]] = {}
            for i, s in enumerate(names):
                where.setdefault(s, []).append(i)
            for s, at in where.items():
                for k, x in per_source(s, b.take(pa.array(at))).items():
                    old = total.get((s, k))
                    total[s, k] = x if old is None else [p + q for p, q in zip(old, x)]
        yield pa.record_batch([pa.array([s for s, _ in total], pa.string()), pa.array([k for _, k in total], pa.int32()), pa.array([pickle.dumps(x) for x in total.values()], pa.binary())], ["source", "k", "blob"])

    return _summed(df.select("source", *columns).mapInArrow(add, "source string, k int, blob binary"))


def reductions(dirs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per source (mean, matrix): (u - mean) @ matrix are the first principal components of the standardised directions."""

    def moments(_: str, b: pa.RecordBatch) -> dict[int, list]:
        u = _matrix(b.column(1), DIMS).astype(np.float64)
        return {0: [np.array([len(u)]), u.sum(0), u.T @ u]}

    out = {}
    for (s, _), (n, total, square) in _sums_of(dirs, moments, ["u"]).items():
        mean = total / n
        cov = square / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        inv = np.where(sd > 1e-9, 1 / np.maximum(sd, 1e-9), 0.0)
        value, vector = np.linalg.eigh(cov * np.outer(inv, inv))
        top = vector[:, ::-1][:, :COMPONENTS]
        top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])  # one orientation
        out[s] = (mean, inv[:, None] * top)
    return out


# ---- one mixture: (weights k, means k x d, variances k x d)


def densities(z: np.ndarray, mix: tuple) -> np.ndarray:
    """log(weight * density) of each row and component."""
    w, m, v = mix
    q = (z * z) @ (1 / v).T - 2 * z @ (m / v).T + (m * m / v).sum(1)
    return np.log(w) - 0.5 * (q + np.log(v).sum(1) + z.shape[1] * np.log(2 * np.pi))


def expect(z: np.ndarray, mix: tuple) -> list[np.ndarray]:
    """[log likelihood, rows, counts, sums, sums of squares]"""
    g = densities(z, mix)
    top = g.max(1, keepdims=True)
    r = np.exp(g - top)
    s = r.sum(1, keepdims=True)
    r /= s
    return [np.array([float((top + np.log(s)).sum())]), np.array([len(z)]), r.sum(0), r.T @ z, r.T @ (z * z)]


def maximise(sums: list[np.ndarray], level: float) -> tuple:
    """level: the mean variance of the source's components."""
    _, n, c, s, q = sums
    c = np.maximum(c, 1e-6)
    m = s / c[:, None]
    v = np.maximum(q / c[:, None] - m * m, 0)
    v = (1 - SHRINK) * v + SHRINK * v.mean(1, keepdims=True)
    return (c / c.sum(), m, np.maximum(v, FLOOR * level))


def criterion(loglik: float, n: float, k: int, d: int) -> float:
    return -2 * loglik + (k * (2 * d + 1) - 1) * np.log(max(n, 2))


def start(z: np.ndarray, k: int, rng: np.random.Generator, tries: int = 2, rounds: int = 25) -> tuple:
    """A mixture of k components fitted on a sample, from seeds far apart."""
    level = float(z.var(0).mean()) or 1.0
    best = None
    for _ in range(tries):
        seeds = [int(rng.integers(len(z)))]
        near = ((z - z[seeds[0]]) ** 2).sum(1)
        for _ in range(k - 1):
            p = near / near.sum() if near.sum() > 0 else None
            seeds.append(int(rng.choice(len(z), p=p)))
            near = np.minimum(near, ((z - z[seeds[-1]]) ** 2).sum(1))
        lab = ((z[:, None, :] - z[seeds][None]) ** 2).sum(2).argmin(1)
        one = np.eye(k)[lab]
        mix = maximise([None, None, one.sum(0), one.T @ z, one.T @ (z * z)], level)
        last = -np.inf
        for _ in range(rounds):
            sums = expect(z, mix)
            mix = maximise(sums, level)
            if sums[0][0] - last < 1e-5 * abs(sums[0][0]):
                break
            last = sums[0][0]
        if best is None or sums[0][0] > best[0]:
            best = (sums[0][0], mix)
    return best[1]


def mixtures(reduced: DataFrame) -> dict[str, tuple]:
    """reduced(source, row_id, z) -> per source the mixture with the least criterion over all rows."""
    h = F.xxhash64("row_id", F.lit(5))
    counts = {r["source"]: r["n"] for r in reduced.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per source
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, min(1.0, SAMPLE / n))])
    picked = reduced.where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < F.try_element_at(share, F.col("source")))

    def starts(tried: dict[str, int]) -> dict[tuple, tuple]:
        """Starting points of the next numbers of groups of each source, after those tried."""

        def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row_id")
            z = np.stack(pdf["z"].to_numpy()).astype(np.float64)
            low = tried[key[0]]
            rng = np.random.default_rng([3, low] if low else 3)
            level = float(z.var(0).mean()) or 1.0
            got = [(k, pickle.dumps((level, start(z, k, rng)))) for k in range(low + 1, min(low + GROUPS_AT_ONCE, len(z)) + 1)]
            return pd.DataFrame({"source": [key[0]] * len(got), "k": [k for k, _ in got], "blob": [x for _, x in got]})

        of = picked.where(F.col("source").isin(list(tried))).groupBy("source")
        return {(r["source"], r["k"]): pickle.loads(r["blob"]) for r in of.applyInPandas(first, "source string, k int, blob binary").collect()}

    mixes = starts(dict.fromkeys(counts, 0))
    for s in counts.keys() - {s for s, _ in mixes}:  # no row was picked of a tiny source
        mixes[s, 1] = (1.0, (np.ones(1), np.zeros((1, COMPONENTS)), np.ones((1, COMPONENTS))))
    last: dict[tuple, float] = {}
    score: dict[tuple, float] = {}
    spark = reduced.sparkSession

    def passed(mixes: dict[tuple, tuple], rows: DataFrame) -> dict[tuple, list[np.ndarray]]:
        """The sums of one pass over all rows; the criterion of each mixture is kept."""
        held = spark.sparkContext.broadcast(mixes)

        def passes(s: str, b: pa.RecordBatch, held=held) -> dict[int, list]:  # noqa: ANN001
            z = _matrix(b.column(1), COMPONENTS).astype(np.float64)
            return {k: expect(z, mix) for (t, k), (_, mix) in held.value.items() if t == s}

        sums = _sums_of(rows, passes, ["z"])
        for key, x in sums.items():
            score[key] = criterion(x[0][0], x[1][0], key[1], COMPONENTS)
        return sums

    def at_the_end(tried: dict[str, int]) -> dict[str, int]:
        """The sources whose best number of groups is the largest one tried, unless too few rows were picked for all numbers."""
        best = {s: min((score[t, k], k) for t, k in score if t == s)[1] for s in tried}
        return {s: n for s, n in tried.items() if best[s] == n}

    for turn in range(PASSES):
        sums = passed(mixes, reduced)
        tried = at_the_end(dict.fromkeys(counts, GROUPS_AT_ONCE)) if turn == 1 else {}
        while tried:
            more = starts(tried)
            if not more:
                break
            rows = reduced.where(F.col("source").isin(list(tried)))
            once = passed(more, rows)
            more = {key: (level, maximise(once[key], level)) for key, (level, _) in more.items()}
            mixes |= more
            sums |= passed(more, rows)
            tried = at_the_end({s: n + GROUPS_AT_ONCE for s, n in tried.items()})
        if turn >= 1:  # after two passes only the best number and its neighbours are carried on
            best = {}
            for (s, k), v in sorted(score.items()):
                if (s, k) in mixes and (s not in best or v < score[s, best[s]]):
                    best[s] = k
            near = 1 if turn == 1 else 0
            mixes = {(s, k): v for (s, k), v in mixes.items() if abs(k - best[s]) <= near}
        settled = all(abs(sums[key][0][0] - last.get(key, -np.inf)) <= CLOSE * abs(sums[key][0][0]) for key in mixes)
        last = {key: x[0][0] for key, x in sums.items()}
        if settled and turn >= 2:
            break
        mixes = {key: (level, maximise(sums[key], level)) for key, (level, _) in mixes.items()}
    best = {}
    for (s, k), _ in sorted(mixes.items()):
        if s not in best or score[s, k] < score[s, best[s]]:
            best[s] = k
    return {s: mixes[s, k][1] for s, k in best.items()}


def grouped(rows: DataFrame) -> DataFrame:
    """rows(row_id, source, cluster_id, vec) -> (row_id, source, cluster_id, grp, density), for every usable row."""
    spark = rows.sparkSession
    dirs = directions(rows).persist(StorageLevel.DISK_ONLY)
    shared = spark.sparkContext.broadcast(reductions(dirs))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _matrix(b.column(3), DIMS).astype(np.float64)
            z = np.zeros((len(u), COMPONENTS), np.float32)
            names = np.array(b.column(1).to_pylist(), object)
            for s in set(names.tolist()):
                mean, matrix = shared.value[s]
                z[names == s] = (u[names == s] - mean) @ matrix
            zs = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), COMPONENTS).cast(pa.list_(pa.float32()))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), zs], ["row_id", "source", "cluster_id", "z"])

    reduced = cut(dirs.mapInArrow(reduce, "row_id long, source string, cluster_id int, z array<float>"))
    dirs.unpersist()
    final = spark.sparkContext.broadcast(mixtures(reduced))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _matrix(b.column(3), COMPONENTS).astype(np.float64)
            names = np.array(b.column(1).to_pylist(), object)
            grp, dens = np.zeros(len(z), np.int32), np.zeros(len(z))
            for s in set(names.tolist()):
                g = densities(z[names == s], final.value[s])
                grp[names == s], dens[names == s] = g.argmax(1), g.max(1)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(grp), pa.array(dens)], ["row_id", "source", "cluster_id", "grp", "density"])

    return reduced.mapInArrow(assign, "row_id long, source string, cluster_id int, grp int, density double")


def named(g: DataFrame) -> DataFrame:
    """(source, grp, group_id, size): the id stored in most rows of each group (the least of several), and its rows."""
    counts = g.groupBy("source", "grp", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source", "grp").agg(F.max_by("cluster_id", F.when(F.col("cluster_id").isNotNull(), F.struct("n", -F.col("cluster_id").cast("long")))).alias("group_id"), F.sum("n").alias("size"))


def typical(g: DataFrame, k: int = 3, parts: int = 64) -> DataFrame:
    """(source, grp, row_id, density, place): the k rows of highest density of each group."""
    order = [F.desc("density"), F.col("row_id")]
    first = g.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(parts))).withColumn("r", F.row_number().over(W.partitionBy("source", "grp", "part").orderBy(*order))).where(F.col("r") <= k)
    return first.withColumn("place", F.row_number().over(W.partitionBy("source", "grp").orderBy(*order))).where(F.col("place") <= k).select("source", "grp", "row_id", "density", "place")
