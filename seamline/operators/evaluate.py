"""One-to-one matching of predictions with truth, its metrics, and the diagnosis of what did not match."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distance_bucket, exact_round
from .keys import Param, value
from .temporal_joins import anti, nearest


def _take_nearest(p_times: np.ndarray, g_times: np.ndarray, g_index: np.ndarray, tolerance: float) -> list[int]:
    """For each prediction in turn the place of the truth that it takes, or -1. Truths lie in order of time, then index.

    Of the free truths only the next on either side can be nearest; both are found by pointers that skip those taken.
    """
    n = len(g_times)
    up, down = list(range(n + 1)), list(range(n + 1))  # next free place from here on; and one more than the last before

    def find(link: list[int], i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    out = []
    for t, at in zip(p_times.tolist(), np.searchsorted(g_times, p_times).tolist()):
        after, before = find(up, at), find(down, at) - 1
        if before >= 0:  # of equal times the lowest index
            before = find(up, int(np.searchsorted(g_times, g_times[before])))
        sides = [(abs(float(g_times[k]) - t), int(g_index[k]), k) for k in (before, after) if 0 <= k < n and abs(float(g_times[k]) - t) <= tolerance]
        if not sides:
            out.append(-1)
            continue
        k = min(sides)[2]
        up[k], down[k + 1] = k + 1, k
        out.append(k)
    return out


def greedy_match(preds: DataFrame, truths: DataFrame, tolerance: Param = 30.0, seq: str = "lecture_id") -> DataFrame:
    """seq, gt_index, gt_time, pred_index, pred_time, abs_error_sec.

    Predictions (time, pred_index) in order of pred_index each take the nearest truth (time, gt_index) that is free and
    within the tolerance (inclusive); of equals the one of lower index. Greedy, so not the largest matching.

    Where predictions and truths leave a gap of more than the tolerance, no choice on one side bears on the other, so a
    sequence is cut there and each part matched on its own. A part without such a gap is one row of its times and
    indices; each prediction's choice takes next to constant time in it, however dense. The tolerance may be a column of
    both tables that each sequence has one value of.
    """
    p = preds.select(seq, F.col("time").cast("double").alias("t"), F.lit(1).alias("is_pred"), F.col("pred_index").cast("int").alias("i"), value(tolerance).alias("_tol"))
    g = truths.select(seq, F.col("time").cast("double").alias("t"), F.lit(0).alias("is_pred"), F.col("gt_index").cast("int").alias("i"), value(tolerance).alias("_tol"))
    w = Window.partitionBy(seq).orderBy("t", "is_pred", "i")
    new = F.coalesce(F.col("t") - F.lag("t").over(w) > F.col("_tol"), F.lit(True)).cast("int")
    both = p.union(g).withColumn("_new", new).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = both.groupBy(seq, "_part", "_tol").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_pred") == 1, F.struct("i", "t")))).alias("_p"),
        F.array_sort(F.collect_list(F.when(F.col("is_pred") == 0, F.struct("t", "i")))).alias("_g"),
    ).where((F.size("_p") > 0) & (F.size("_g") > 0))

    @F.pandas_udf("array<int>")
    def take(p_times: pd.Series, g_times: pd.Series, g_index: pd.Series, within: pd.Series) -> pd.Series:
        return pd.Series([_take_nearest(np.asarray(a, float), np.asarray(b, float), np.asarray(c), d) for a, b, c, d in zip(p_times, g_times, g_index, within)])

    taken = parts.withColumn("_k", take(F.col("_p.t"), F.col("_g.t"), F.col("_g.i"), F.col("_tol")))
    rows = taken.select(seq, "_g", F.explode(F.arrays_zip("_p", "_k")).alias("_m")).where("_m._k >= 0").select(seq, F.col("_m._p").alias("p"), F.element_at("_g", F.col("_m._k") + 1).alias("g"))
    return rows.select(seq, F.col("g.i").alias("gt_index"), F.col("g.t").alias("gt_time"), F.col("p.i").alias("pred_index"), F.col("p.t").alias("pred_time"), F.abs(F.col("g.t") - F.col("p.t")).alias("abs_error_sec"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def metrics(tp: Column, preds: Column, truths: Column) -> dict[str, Column]:
    """precision, recall, f1; 0 where undefined."""
    p, r = ratio(tp, preds), ratio(tp, truths)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))}


def report(preds: DataFrame, truths: DataFrame, tolerance: Param = 30.0, seq: str = "lecture_id", sequences: DataFrame | None = None) -> DataFrame:
    """seq, pred_count, gt_count, tp, fp, fn, precision, recall, f1 for each sequence that has truths (or of sequences)."""
    every = (truths.select(seq) if sequences is None else sequences.select(seq)).distinct()
    found = greedy_match(preds, truths, tolerance, seq).groupBy(seq).agg(F.count("*").alias("tp"))
    counts = every.join(preds.groupBy(seq).agg(F.count("*").alias("pred_count")), seq, "left").join(truths.groupBy(seq).agg(F.count("*").alias("gt_count")), seq, "left").join(found, seq, "left").na.fill(0, ["pred_count", "gt_count", "tp"])
    tp, n, m = F.col("tp"), F.col("pred_count"), F.col("gt_count")
    return counts.select(seq, "pred_count", "gt_count", "tp", (n - tp).alias("fp"), (m - tp).alias("fn"), *(v.alias(k) for k, v in metrics(tp, n, m).items()))


def false_positives(preds: DataFrame, truths: DataFrame, tolerance: float = 30.0, middle: float = 120.0, seq: str = "lecture_id") -> DataFrame:
    """Unmatched predictions with the nearest truth's index and distance, and their bucket."""
    loose = anti(preds, greedy_match(preds, truths, tolerance, seq), seq, "pred_index")
    right = truths.select(seq, F.col("time").alias("r_time"), F.col("gt_index").alias("r_idx"))
    return nearest(loose, right, seq).withColumn("fp_bucket", distance_bucket(F.col("distance"), tolerance, middle))


def bucket_shares(false_pos: DataFrame, seq: str = "lecture_id") -> DataFrame:
    """Counts and percentages (2 digits) of each bucket, absent ones as 0."""
    names = ["redundant_near_gt", "offset_near_miss", "spurious_far"]
    counts = false_pos.groupBy(seq).agg(F.count("*").alias("fp"), *(F.count_if(F.col("fp_bucket") == b).alias(b) for b in names))
    return counts.select("*", *(F.round(100 * ratio(F.col(b), F.col("fp")), 2).alias(f"{b}_pct") for b in names))


def hit_rates(truths: DataFrame, preds: DataFrame, tolerances: list[float], seq: str = "lecture_id") -> DataFrame:
    """For each tolerance the percentage of truths that have any prediction within it; not one-to-one."""
    right = preds.select(seq, F.col("time").alias("r_time"), F.col("pred_index").alias("r_idx"))
    near = nearest(truths, right, seq, tie="later")
    wide = near.select(seq, "distance", F.explode(F.array(*map(F.lit, tolerances))).alias("tolerance"))
    return wide.groupBy(seq, "tolerance").agg(F.count("*").alias("gt_count"), F.count_if(F.col("distance") <= F.col("tolerance")).alias("hits")).withColumn("hit_rate", 100 * ratio(F.col("hits"), F.col("gt_count")))


# ---- tables of results

def macro_average(rows: DataFrame, *keys: str) -> DataFrame:
    """Means over sequences of 4-digit precision, recall and f1, to 4 digits, and of the number of predictions. The sums
    are of whole numbers of ten-thousandths, so the means don't depend on the order of rows."""
    names = ("precision", "recall", "f1")
    parts = rows.select(*keys, "pred_count", *(F.bround(exact_round(F.col(c), 4) * 10_000, 0).cast("long").alias(c) for c in names))
    means = [exact_round(F.sum(c) / (F.count("*") * 10_000), 4).alias(f"avg_{c}") for c in names]
    return parts.groupBy(*keys).agg(*means, F.round(F.avg("pred_count"), 2).alias("avg_pred_count"), F.count("*").alias("n"))


def pivot_f1(rows: DataFrame, key: str, sequences: list, seq: str = "lecture_id") -> DataFrame:
    """A row per key, a column per sequence (0 if missing), and their mean."""
    wide = rows.groupBy(key).pivot(seq, sequences).agg(F.first("f1")).na.fill(0.0)
    names = [str(s) for s in sequences]
    return wide.withColumn("avg_f1", sum((F.col(f"`{n}`") for n in names), F.lit(0.0)) / len(names))


def best_row(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """The row of greatest value for each key (of the whole table without one); the first in order of equals."""
    fine = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(value), -F.col(order)))
    return fine.groupBy(*keys).agg(best.alias("_b")).where("_b is not null").select("_b.*")


def improvements(rows: DataFrame, baseline: DataFrame, key: str, seq: str = "lecture_id", least: float = 1e-6) -> DataFrame:
    """How many sequences are better, worse or the same as the baseline's f1 (0 where it has none), for each key."""
    both = rows.join(baseline.select(seq, F.col("f1").alias("_base")), seq, "left").withColumn("_d", F.col("f1") - F.coalesce("_base", F.lit(0.0)))
    return both.groupBy(key).agg(F.count_if(F.col("_d") > least).alias("improved"), F.count_if(F.col("_d") < -least).alias("worse"), F.count_if(F.abs("_d") <= least).alias("unchanged"))


def compare_versions(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Metrics under two versions of the truth side by side, with differences; keys in both only."""
    names = ("precision", "recall", "f1")
    a = old.select(*keys, *(F.col(c).alias(f"{c}_orig") for c in names))
    b = new.select(*keys, *(F.col(c).alias(f"{c}_corrected") for c in names))
    return a.join(b, list(keys)).select("*", *((F.col(f"{c}_corrected") - F.col(f"{c}_orig")).alias(f"delta_{c}") for c in names))
