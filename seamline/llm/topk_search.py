"""Exact top-k search by integer inner product: tiled matrix products, selection per tile, merging of top lists.

Nulls: a vector that is null, or holds a null or a non-finite component, takes no part, nor does a row with a null id.
Vectors of another length than a query's are no candidates for it; an empty vector takes no part. A candidate with the
query's own id counts as the query's own row, so repeated rows never find each other; a repeated query is asked once,
with the least of its vectors if they differ. Scores that 64 bits may not hold raise an error.
Ties go to the smaller id. A query with fewer than k candidates has all of them. An empty table gives an empty result.
Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score long"


def quantized(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as long; only rows that take part."""
    x = F.col(vector).cast("array<double>")
    fine = F.size(x).__gt__(0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", F.transform("x", lambda v: F.floor(v * F.lit(scale)).cast("long")).alias("v"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer product; by floating point where no sum can leave its exact range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 2**63:
        raise ArithmeticError("scores may be too large for 64 bits")
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _tile_top(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's best k of a shard."""
    q_ids, v_ids = queries["vec_id"].to_numpy("int64"), shard["vec_id"].to_numpy("int64")
    order = np.argsort(v_ids, kind="stable")
    v_ids, b = v_ids[order], np.stack(shard["v"].to_numpy()).astype(np.int64)[order]
    a, out = np.stack(queries["v"].to_numpy()).astype(np.int64), []
    for at in range(0, len(q_ids), 256):
        ids = q_ids[at : at + 256]
        score = _product(a[at : at + 256], b)
        own = ids[:, None] == v_ids[None, :]
        take = min(k, len(v_ids))
        # the k-th highest score is the least that can count; of equal ones the earlier columns have the smaller ids
        low = np.iinfo(np.int64).min
        masked = np.where(own, low, score)
        floor = -np.partition(-np.maximum(masked, low + 1), take - 1, axis=1)[:, take - 1]
        row, col = np.nonzero((masked >= floor[:, None]) & ~own)
        rank_order = np.lexsort((col, -masked[row, col], row))
        row, col = row[rank_order], col[rank_order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out.append(pd.DataFrame({"query_id": ids[row[keep]], "vec_id": v_ids[col[keep]], "score": score[row[keep], col[keep]]}))
    return pd.concat(out)


def top_k(vectors: DataFrame, id_col: str, vector: str, is_query: Column, k: int = 5, scale: float = 256.0, query_block: int = 8192, shard_rows: int = 8192) -> DataFrame:
    """The k best of all rows for each row for which is_query holds: query_id, rank, vec_id, score.

    Queries, each once, are dealt to blocks by a hash of the id, rows to shards by their places, so that repeated rows
    are spread; both are of bounded size. Each (block, shard) tile is one matrix product in one task. Per-query lists of k are then merged twice: within groups of shards, then over
    the groups. What moves is (number of query blocks) x rows and (number of shards) x queries.
    """
    n = vectors.select(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    rows = quantized(vectors, id_col, vector, scale)
    most = rows.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] or 0
    narrow = F.col("v").cast(f"array<{'smallint' if most < 2**15 else 'int' if most < 2**31 else 'bigint'}>").alias("v")  # what moves
    rows = rows.select("vec_id", narrow, F.size("v").alias("dim"))
    asked = quantized(vectors.where(is_query), id_col, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", narrow, F.size("v").alias("dim"))
    shards, blocks = max(1, -(-n["n"] // shard_rows)), max(1, -(-n["q"] // query_block))
    group = max(1, int(shards**0.5))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "v", "dim", dealt(blocks, "vec_id", "v").alias("qb")).select("*", every(shards).alias("shard"))
    right = rows.select("vec_id", "v", "dim", dealt(shards, F.monotonically_increasing_id()).alias("shard")).select("*", every(blocks).alias("qb"))

    def tile(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "lot": []}).astype("int64")
        return _tile_top(queries, shard, k).assign(lot=int(queries["shard"].iloc[0]) % group)

    keys = ["qb", "shard", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, FOUND + ", lot long")
    best = [F.col("score").desc(), F.col("vec_id")]
    # repeated rows of one id are each a candidate
    within = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "lot").orderBy(*best))).where(F.col("r") <= k).drop("r")
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
