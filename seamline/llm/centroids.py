"""Centroid clustering: plain Lloyd over integer vectors, the same on any number of machines.

Each component x of a vector becomes floor(scale * x); from there on everything is integer arithmetic, so no sum depends
on the order of its parts. A round broadcasts the centroids (k * dim integers, whatever the table's size). Each task
takes its vectors' squared differences to one centroid after the other, keeps the least with the lowest number, and
gives one row of sums for each centroid it met; a groupBy adds these up. Vectors never move.

A vector takes part if it has exactly ``dim`` components, none of them null or non-finite. One with a null id takes part
but can't be a first centroid; rows of one id each take part, and of equal hashes the lesser vector comes first. Equal
distances go to the lower centroid, and a centroid without vectors stays where it is. With fewer than k vectors there
are as many centroids as can be had, and none if no vector has an id: the result is empty then, as for an empty table.
Components beyond what 64-bit distances can hold raise an error. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Vectors compared with a centroid at once.
TILE = 2048


def _limit(dim: int) -> int:
    """Components below it have squared distances that 64 bits can hold."""
    return int((2**61 / max(dim, 1)) ** 0.5)


def quantized(ids: pd.Series, vectors: pd.Series, dim: int, scale: float) -> tuple[pd.Series, np.ndarray]:
    """The ids of the vectors that take part, and floor(scale * x) of their components, one row each."""
    sized = np.array([v is not None and len(v) == dim for v in vectors], bool)
    if not sized.any():
        return ids[sized], np.zeros((0, dim), np.int64)
    x = np.stack([np.asarray(v, np.float64) for v in vectors[sized]])
    fine = np.isfinite(x).all(axis=1)
    whole = np.floor(x[fine] * scale)
    if np.abs(whole).max(initial=0) >= _limit(dim):
        raise ArithmeticError("distances may be too large for 64 bits")
    return ids[sized][fine], whole.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centroid, the lowest of equals, and the squared distance."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    small = (2 * most) ** 2 * x.shape[1] < 2**31  # then 32 bits hold the sums
    kind = np.int32 if small else np.int64
    x, centroids = x.astype(kind), centroids.astype(kind)
    which, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), TILE):
        part = x[at : at + TILE]
        found = np.empty((len(centroids), len(part)), kind)
        for j, c in enumerate(centroids):
            d = part - c
            found[j] = np.einsum("ij,ij->i", d, d)
        which[at : at + TILE] = best = found.argmin(axis=0)
        least[at : at + TILE] = found[best, np.arange(len(part))]
    return which, least


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of rows (vec_id, v) whose id's hash is least, in that order."""
    named = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(k).collect()], np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's vectors."""
    spark, dim = rows.sparkSession, centroids.shape[1]
    shared = spark.sparkContext.broadcast(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(shared.value.shape, np.int64), np.zeros(len(shared.value), np.int64)
        for frame in frames:
            x = np.stack(frame["v"].to_numpy()).astype(np.int64)
            which, _ = nearest(x, shared.value)
            count += np.bincount(which, minlength=len(count))
            order = np.argsort(which, kind="stable")
            met, first = np.unique(which[order], return_index=True)
            total[met] += np.add.reduceat(x[order], first, axis=0)
        met = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": met.astype(np.int32), "n": count[met], "s": list(total[met])})

    parts = rows.select("v").mapInPandas(sums, "cluster int, n long, s array<long>")
    added = parts.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)])
    out = centroids.copy()
    for r in added.collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dim)]
    shared.unpersist()
    return out


def lloyd(vectors: DataFrame, id_col: str, vector: str, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """Each vector that takes part with its centroid's number and the squared distance (vec_id, cluster, distance), in a
    written table, and the final centroids."""
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept, x = quantized(frame["vec_id"], frame["x"], dim, scale)
            if len(x):
                yield pd.DataFrame({"vec_id": kept.astype("Int64").array, "v": list(x)})

    rows = written(ids.mapInPandas(whole, "vec_id long, v array<long>"), "vectors")
    centroids = first_centroids(rows, k, seed)
    assigned = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], assigned), np.zeros((0, dim), np.int64)
    for _ in range(rounds):
        centroids = _moved(rows, centroids)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            which, least = nearest(np.stack(frame["v"].to_numpy()).astype(np.int64), shared.value)
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": which.astype(np.int32), "distance": least})

    return written(rows.mapInPandas(assign, assigned), "assigned"), centroids


def described(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia (sums of distances over the cluster and over all) and centroid_sha256."""
    own = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    digest = {j: sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest() for j in own}
    rows = [(j, own[j], sum(own.values()), digest[j]) for j in own]
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part."""
    assigned, centroids = lloyd(vectors, id_col, vector, **how)
    return described(vectors.sparkSession, assigned, centroids)
