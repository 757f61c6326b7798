"""What a plot shows, as tables: no picture needs more rows than it has pixels, however long the curve.

A curve is thinned to its first, lowest, highest and last point in each column of pixels, which draw the same line. A
zoom panel shows the part of the curve around a truth, with the points just outside that the line runs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dissimilarity
from ..operators import temporal_joins as J
from ..operators.keys import Seq, keys

#: Seconds either side of a truth that its panel shows, and panels in a row. Fixed values.
ZOOM, COLUMNS = 120.0, 3


def curve(edges: DataFrame, seq: Seq = "lecture_id", invert: bool = False) -> DataFrame:
    """seq, x (the right window's start), y (similarity, or 1 - similarity)."""
    y = dissimilarity(F.col("similarity")) if invert else F.col("similarity")
    return edges.select(*keys(seq), F.col("right_start").cast("double").alias("x"), y.cast("double").alias("y"))


def thinned(points: DataFrame, column: Column, *whole: str) -> DataFrame:
    """whole, column, x, y: of the points (x, y) of a column the first, the lowest, the highest and the last; of equal
    ones the earliest. A point that is several of these comes once."""
    picks = [F.min(F.struct("x", "y")), F.min(F.struct("y", "x")), F.max(F.struct("y", (-F.col("x")).alias("n"), "x")), F.max(F.struct("x", "y"))]
    found = points.groupBy(*whole, column.cast("int").alias("column")).agg(*(p.alias(f"_{i}") for i, p in enumerate(picks)))
    every = F.array_distinct(F.array(*(F.struct(F.col(f"_{i}.x").alias("x"), F.col(f"_{i}.y").alias("y")) for i in range(4))))
    return found.select(*whole, "column", F.inline(every))


def _column(x: Column, left: Column, right: Column, pixels: int) -> Column:
    """The column of pixels that x falls in, between left and right."""
    at = F.floor((x - left) / (right - left) * pixels)
    return F.when(right > left, F.greatest(F.lit(0), F.least(F.lit(pixels - 1), at))).otherwise(F.lit(0))


def overview(edges: DataFrame, pixels: int = 1800, seq: Seq = "lecture_id", invert: bool = False) -> DataFrame:
    """seq, column, x, y: each sequence's curve from its first to its last time."""
    whole, points = keys(seq), curve(edges, seq, invert)
    extent = points.groupBy(*whole).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    return thinned(points.join(extent, whole), _column(F.col("x"), F.col("_x0"), F.col("_x1"), pixels), *whole)


def lines(truths: DataFrame, preds: DataFrame, edges: DataFrame, seq: Seq = "lecture_id", invert: bool = False) -> DataFrame:
    """seq, kind (truth or prediction), x, label, label_y: vertical lines; truths are labelled at the curve's top, or at
    1 where there is no curve."""
    whole = keys(seq)
    tops = curve(edges, seq, invert).groupBy(*whole).agg(F.max("y").alias("_top"))
    none = F.lit(None)
    told = truths.join(tops, whole, "left").select(*whole, F.lit("truth").alias("kind"), F.col("time").alias("x"), F.col("time_str").alias("label"), F.coalesce("_top", F.lit(1.0)).alias("label_y"))
    return told.unionByName(preds.select(*whole, F.lit("prediction").alias("kind"), F.col("boundary_time").alias("x"), none.cast("string").alias("label"), none.cast("double").alias("label_y")))


def zoom_panels(edges: DataFrame, truths: DataFrame, preds: DataFrame, window: float = ZOOM, seq: str = "lecture_id", invert: bool = False) -> DataFrame:
    """A row for each truth: its place in the grid (row, col; rows of the grid), x_min, x_max, preds (times within, in
    order), and its dip (dip_x, dip_y: the lowest point within, the first of equals; null without a point)."""
    points = curve(edges, seq, invert)
    n = F.count("*").over(Window.partitionBy(seq))
    place = F.row_number().over(Window.partitionBy(seq).orderBy("gt_index")) - 1
    panels = truths.select(seq, "gt_index", "time", (place / COLUMNS).cast("int").alias("row"), (place % COLUMNS).alias("col"), F.ceil(n / COLUMNS).cast("int").alias("rows"), (F.col("time") - window).alias("x_min"), (F.col("time") + window).alias("x_max"))
    near = J.within(panels.select(seq, "gt_index", "time"), points.select(seq, F.col("x").alias("r_time"), "y"), window, seq)
    low = near.groupBy(seq, "gt_index").agg(F.min(F.struct("y", "r_time")).alias("_low"))
    held = J.within(panels.select(seq, "gt_index", "time"), preds.select(seq, F.col("boundary_time").alias("r_time")), window, seq)
    held = held.groupBy(seq, "gt_index").agg(F.array_sort(F.collect_list("r_time")).alias("preds"))
    rows = panels.join(low, [seq, "gt_index"], "left").join(held, [seq, "gt_index"], "left")
    return rows.select(seq, "gt_index", "row", "col", "rows", "x_min", "x_max", F.coalesce("preds", F.array().cast("array<double>")).alias("preds"), F.col("_low.r_time").alias("dip_x"), F.col("_low.y").alias("dip_y"))


def zoom_curves(edges: DataFrame, truths: DataFrame, window: float = ZOOM, pixels: int = 600, seq: str = "lecture_id", invert: bool = False) -> DataFrame:
    """seq, gt_index, column, x, y: the thinned curve of each truth's panel. Points outside have the column of the edge
    that the line to them crosses (-1 or ``pixels``); there is one on each side at most."""
    order = Window.partitionBy(seq).orderBy("x")
    points = curve(edges, seq, invert)
    steps = points.select(seq, F.col("x").alias("start"), F.coalesce(F.lead("x").over(order), F.col("x")).alias("end"), "y", F.coalesce(F.lead("y").over(order), F.col("y")).alias("_next"))
    spans = truths.select(seq, "gt_index", (F.col("time") - window).alias("r_start"), (F.col("time") + window).alias("r_end"))
    met = J.overlapping(steps, spans, 2 * window, closed=True, seq=seq)
    ends = F.inline(F.array(F.struct(F.col("start").alias("x"), "y"), F.struct(F.col("end").alias("x"), F.col("_next").alias("y"))))
    shown = met.select(seq, "gt_index", "r_start", "r_end", ends).distinct()
    inside = _column(F.col("x"), F.col("r_start"), F.col("r_end"), pixels)
    column = F.when(F.col("x") < F.col("r_start"), F.lit(-1)).when(F.col("x") > F.col("r_end"), F.lit(pixels)).otherwise(inside)
    return thinned(shown, column, seq, "gt_index")


def bars(rows: DataFrame, category: str, series: list[str], width: float) -> DataFrame:
    """category, series, place, left, height: bars of a grouped chart; null or missing heights are 0. Categories stand in
    order of their column ``place``, the series of one side by side, centred on it."""
    middle = (len(series) - 1) / 2
    each = F.array(*(F.struct(F.lit(s).alias("series"), F.lit((i - middle) * width).alias("_shift"), F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias("height")) for i, s in enumerate(series)))
    return rows.select(category, "place", F.inline(each)).select(category, "series", "place", (F.col("place") + F.col("_shift") - width / 2).alias("left"), "height")
