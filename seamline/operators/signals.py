"""Similarity curves, dips, prominence and textual cue signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FILLERS, MARKER_TAGS, any_cue, cue_count
from ..functions.vectors import cosine, norm
from .keys import Seq, keys


def adjacent_similarity(windows: DataFrame, seq: Seq = "lecture_id", order: str = "window_id") -> DataFrame:
    """An edge between each window (embedding, start, end) and the next: ids, times, similarity. Norms are taken once."""
    w = Window.partitionBy(*keys(seq)).orderBy(order)
    rows = windows.select(*keys(seq), order, "start", "end", "embedding", norm(F.col("embedding")).alias("_norm"))
    ahead = rows.select("*", *(F.lead(c).over(w).alias(f"_next_{c}") for c in (order, "start", "end", "embedding", "_norm"))).where(F.col(f"_next_{order}").isNotNull())
    return ahead.select(
        *keys(seq),
        F.col(order).alias("left_window_id"), F.col(f"_next_{order}").alias("right_window_id"),
        F.col("start").alias("left_start"), F.col("end").alias("left_end"),
        F.col("_next_start").alias("right_start"), F.col("_next_end").alias("right_end"),
        cosine(F.col("embedding"), F.col("_next_embedding"), F.col("_norm"), F.col("_next__norm")).alias("similarity"),
    )


def local_minimum(value: str, seq: Seq, *order: str) -> Column:
    """Strictly below both neighbours; never true at an end."""
    w = Window.partitionBy(*keys(seq)).orderBy(*order)
    return F.coalesce((F.col(value) < F.lag(value).over(w)) & (F.col(value) < F.lead(value).over(w)), F.lit(False))


def local_peak(value: str, seq: Seq, *order: str) -> Column:
    """Not below either neighbour; a missing one counts as equal."""
    w, v = Window.partitionBy(*keys(seq)).orderBy(*order), F.col(value)
    return (v >= F.coalesce(F.lag(value).over(w), v)) & (v >= F.coalesce(F.lead(value).over(w), v))


def prominence(value: str, span: int, seq: Seq, *order: str) -> Column:
    """How far the value lies below the lower of the means of the ``span`` values before and after it; 0 at an end."""
    w = Window.partitionBy(*keys(seq)).orderBy(*order)
    before, after = F.avg(value).over(w.rowsBetween(-span, -1)), F.avg(value).over(w.rowsBetween(1, span))
    return F.when(before.isNull() | after.isNull(), F.lit(0.0)).otherwise(F.least(before - F.col(value), after - F.col(value)))


def shaped(edges: DataFrame, span: int = 1, seq: Seq = "lecture_id") -> DataFrame:
    """edges with _minimum and prominence: all of a curve's shape that rules for boundaries ask for."""
    return edges.withColumn("_minimum", local_minimum("similarity", seq, "left_window_id")).withColumn("prominence", prominence("similarity", span, seq, "left_window_id"))


def dips(edges: DataFrame, threshold: float = 0.55, need_minimum: bool = True, least_prominence: float | None = None, span: int = 1, seq: Seq = "lecture_id") -> DataFrame:
    """Boundary candidates: edges under the threshold, by choice only local minima, by choice of some prominence.

    boundary_time is the right window's start. Indices are dense in each sequence.
    """
    rows = shaped(edges, span, seq)
    reason = "low_similarity_and_local_minimum" if need_minimum else "low_similarity"
    rows = rows.where(F.col("similarity") < threshold)
    if need_minimum:
        rows = rows.where("_minimum")
    if least_prominence is not None:
        rows = rows.where(F.col("prominence") >= F.lit(least_prominence) - 1e-12).withColumn("prominence", F.round("prominence", 6))
    extra = ["prominence"] if least_prominence is not None else []
    rows = rows.select(*keys(seq), F.array("left_window_id", "right_window_id").alias("between_windows"), F.col("right_start").alias("boundary_time"), "similarity", F.col("left_end").alias("left_window_end"), F.col("right_start").alias("right_window_start"), F.lit(reason).alias("reason"), *extra)
    return reindexed(rows, "boundary_index", seq, "boundary_time", "between_windows")


def reindexed(rows: DataFrame, name: str, seq: Seq, *order: str) -> DataFrame:
    """rows with a dense index from 0 in each sequence, in place of any column of that name."""
    number = (F.row_number().over(Window.partitionBy(*keys(seq)).orderBy(*order)) - 1).cast("int").alias(name)
    return rows.drop(name).select("*", number)


def marker_times(cues: DataFrame, patterns: list[str] | None = None, seq: Seq = "lecture_id") -> DataFrame:
    """Starts of the cues in which any discourse marker occurs: seq, time, idx."""
    rows = cues.where(any_cue(F.col("text"), patterns or [p for _, p in MARKER_TAGS]))
    return rows.select(seq, F.col("start").alias("time"), F.col("block_id").alias("idx"))


def filler_peaks(cues: DataFrame, fillers: list[str] | None = None, least: int = 3, window: float = 20.0, seq: Seq = "lecture_id") -> DataFrame:
    """Starts at which the number of fillers within half a window either side peaks: seq, time, idx, fillers."""
    counts = cues.select(seq, "block_id", F.col("start").alias("time"), cue_count(F.col("text"), fillers or FILLERS).alias("_c"))
    half = f"{window / 2!r}D"
    rows = counts.withColumn("fillers", F.expr(f"sum(_c) OVER (PARTITION BY `{seq}` ORDER BY time RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)"))
    rows = rows.withColumn("_peak", local_peak("fillers", seq, "block_id"))
    return rows.where(F.col("_peak") & (F.col("fillers") >= least)).select(seq, "time", F.col("block_id").alias("idx"), "fillers")
