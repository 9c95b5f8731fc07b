"""Clusterings, reductions and classifiers, by the machine-learning library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 0) -> DataFrame:
    """df with cluster_id; with a single cluster or row all are cluster 0. The number of clusters is at most that of rows."""
    n = df.count()
    k = min(k, n)
    if k <= 1:
        return df.withColumn("cluster_id", F.lit(0))
    data = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster_id", maxIter=20).fit(data)
    return model.transform(data).drop("_v")


def reduce(df: DataFrame, vec: str, k: int, fit_on: Column | None = None, whiten: bool = False) -> DataFrame:
    """df with z: its first k principal components, fitted on the rows of fit_on; whitened to unit variance if asked."""
    data = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    base = data.where(fit_on) if fit_on is not None else data
    center = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(base)
    pca = PCA(k=k, inputCol="_c", outputCol="_p").fit(center.transform(base))
    out = pca.transform(center.transform(data))
    if whiten:
        out = StandardScaler(withMean=False, withStd=True, inputCol="_p", outputCol="_w").fit(pca.transform(center.transform(base))).transform(out).drop("_p").withColumnRenamed("_w", "_p")
    return out.withColumn("z", vector_to_array("_p")).drop("_v", "_c", "_p")


def moments(df: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, n, mean, cov): moments of each group as flat arrays. Each task sums its own rows first, so groups of any size meet
    only as sums."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for k, g in b.groupby(by):
                x = np.stack(g[vec].to_numpy()).astype(np.float64)
                n, s, q = total.get(k, (0, 0.0, 0.0))
                total[k] = (n + len(x), s + x.sum(0), q + x.T @ x)
        yield pd.DataFrame([(k, n, s, q.ravel()) for k, (n, s, q) in total.items()], columns=[by, "n", "s", "q"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, q = pdf["n"].sum(), np.sum(np.stack(pdf["s"].to_numpy()), 0), np.sum(np.stack(pdf["q"].to_numpy()), 0)
        m = s / n
        return pd.DataFrame({by: [key[0]], "n": [n], "mean": [m], "cov": [q / n - np.outer(m, m).ravel()]})

    kind = dict(df.dtypes)[by]
    parts = df.select(by, vec).where(F.col(by).isNotNull() & F.col(vec).isNotNull()).mapInPandas(part, f"{by} {kind}, n long, s array<double>, q array<double>")
    return parts.groupBy(by).applyInPandas(add, f"{by} {kind}, n long, mean array<double>, cov array<double>")


def covariances(df: DataFrame, by: str, vec: str, ridge: float = 1e-3) -> DataFrame:
    """(by, i, j, cov, inverse), i <= j from 1: the covariance of each group over all dimensions with ridge on its diagonal, and
    its inverse (the pseudo-inverse where there is none)."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, m, c in zip(b[by], b["mean"], b["cov"]):
                d = len(m)
                full = np.asarray(c).reshape(d, d) + ridge * np.eye(d)
                inv = np.linalg.pinv(full, hermitian=True)
                i, j = np.triu_indices(d)
                yield pd.DataFrame({by: k, "i": i + 1, "j": j + 1, "cov": full[i, j], "inverse": inv[i, j]})

    return moments(df, by, vec).mapInPandas(entries, f"{by} {dict(df.dtypes)[by]}, i long, j long, cov double, inverse double")


def mahalanobis(df: DataFrame, by: str, vec: str, ridge: float = 1e-3, least: int = 5) -> DataFrame:
    """df with d2: squared Mahalanobis distance to the row's group; a group of fewer than `least` rows falls back to the squared
    distance from its mean."""
    m = F.broadcast(moments(df, by, vec).withColumnRenamed(by, "_by"))  # a row per group

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.full(len(b), np.nan)
            for _, g in b.groupby(by):
                row = g.iloc[0]
                x = np.stack(g[vec].to_numpy()).astype(np.float64) - row["mean"]
                d = x.shape[1]
                inv = np.linalg.pinv(np.asarray(row["cov"]).reshape(d, d) + ridge * np.eye(d)) if row["n"] >= least else np.eye(d)
                out[b.index.get_indexer(g.index)] = np.einsum("ij,jk,ik->i", x, inv, x)
            yield b.drop(columns=["n", "mean", "cov"]).assign(d2=out)

    fields = ", ".join(f"{k} {t}" for k, t in df.dtypes)
    return df.join(m, df[by] == m["_by"]).drop("_by").mapInPandas(score, fields + ", d2 double")


def folds(df: DataFrame, vec: str, label: str, fold: str, kind: str = "logistic") -> DataFrame:
    """(fold, n, hits): classifiers trained without a fold and tested on it; kind is logistic or perceptron."""
    data = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double")))).withColumn("_y", F.col(label).cast("double")).persist()
    out = None
    dims = len(data.first()[vec])
    for r in data.select(fold).distinct().orderBy(fold).collect():  # the few folds
        train, test = data.where(F.col(fold) != r[0]), data.where(F.col(fold) == r[0])
        if kind == "perceptron":
            m = MultilayerPerceptronClassifier(featuresCol="_v", labelCol="_y", layers=[dims, 16, 2], maxIter=20, seed=0).fit(train)
        else:
            m = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=20, regParam=0.01).fit(train)
        got = m.transform(test).groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("_y")).alias("hits"))
        out = got if out is None else out.unionByName(got)
    return out
