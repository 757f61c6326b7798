"""Joins on time: within a distance, overlapping, nearest, as-of, and by half-open interval.

Distance and overlap joins are equi-joins on (sequence, time bucket) with the exact predicate on top, so they never
plan as a nested loop, and a long sequence is spread over its buckets.

Nearest and as-of joins cut a sequence into ranges of ``span`` seconds. What a range knows of the others is one row from
before it and one from after it, carried over a table with a row for each range; within it, it is a sort each way. So
no task holds more than a range, however long the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import Param, Seq, keys, value

#: Seconds of a range: of events as dense as a spoken lecture's some ten thousand rows.
SPAN = 86400.0


def within(left: DataFrame, right: DataFrame, distance: Param, seq: str = "lecture_id", left_time: str = "time", right_time: str = "r_time", how: str = "inner", most: float | None = None) -> DataFrame:
    """Pairs with abs(left - right) <= distance (inclusive). Of the columns only seq may be shared. how: inner, left_semi
    or left_anti. The distance may be a column of left, of values up to ``most``."""
    width = max(float(distance if most is None else most), 1e-6)
    bucket = lambda t: F.floor(F.col(t) / width)
    r = right.select(*right.columns, bucket(right_time).alias("_b"))
    spread = left.select(*left.columns, F.explode(F.array(*(bucket(left_time) + k for k in (-1, 0, 1)))).alias("_b"))
    close = F.abs(F.col(left_time) - F.col(right_time)) <= value(distance)
    if how == "inner":
        return spread.join(r, [seq, "_b"]).where(close).drop("_b")
    semi = r.select(F.col(seq).alias("_s"), F.col(right_time).alias("_rt"), F.explode(F.array(*(F.col("_b") + k for k in (-1, 0, 1)))).alias("_b"))
    rows = left.withColumn("_lb", bucket(left_time))
    on = (rows[seq] == semi["_s"]) & (rows["_lb"] == semi["_b"]) & (F.abs(rows[left_time] - semi["_rt"]) <= value(distance))
    return rows.join(semi, on, how).drop("_lb")


def overlapping(left: DataFrame, right: DataFrame, width: float, closed: bool = False, seq: str = "lecture_id", left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """Pairs of intervals that overlap (with closed, also those that touch). Each pair is made in one bucket of
    ``width``: that of the later start."""
    bucket = lambda t: F.floor(t / float(width))
    (ls, le), (rs, re) = left_span, right_span
    spread = lambda df, s, e: df.where(F.col(e) >= F.col(s)).select(*df.columns, F.explode(F.sequence(bucket(F.col(s)), bucket(F.col(e)))).alias("_b"))
    pairs = spread(left, ls, le).join(spread(right, rs, re), [seq, "_b"])
    meets = ~((F.col(le) < F.col(rs)) | (F.col(ls) > F.col(re))) if closed else (F.col(le) > F.col(rs)) & (F.col(ls) < F.col(re))
    return pairs.where(meets & (F.col("_b") == bucket(F.greatest(ls, rs)))).drop("_b")


def _sides(left: DataFrame, right: DataFrame, seq: Seq, left_time: str, right_time: str, idx: str, span: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables in one, with _t and its range _b, right rows of one time folded to their first in list order, as
    struct _r; for each range _back and _ahead, the nearest right rows of other ranges, and _lead, the sequence's first."""
    whole = keys(seq)
    payload = [c for c in right.columns if c not in whole]
    r = right.groupBy(*whole, F.col(right_time).alias("_t")).agg(F.min_by(F.struct(*payload), idx).alias("_r"))
    nothing = F.lit(None).cast(r.schema["_r"].dataType)
    lefts = left.select(*whole, F.col(left_time).alias("_t"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_l"), nothing.alias("_r"))
    rights = r.select(*whole, "_t", F.lit(0).alias("_left"), F.lit(None).cast(lefts.schema["_l"].dataType).alias("_l"), "_r")
    number = F.floor(F.col("_t") / float(span)).alias("_b")
    both = lefts.unionByName(rights).select("*", number)
    known = r.select(*whole, number, "_t", "_r").groupBy(*whole, "_b").agg(F.min_by("_r", "_t").alias("_first"), F.max_by("_r", "_t").alias("_last"))
    asked = left.select(*whole, F.floor(F.col(left_time) / float(span)).alias("_b")).distinct()
    ranges = asked.join(known, [*whole, "_b"], "full")
    w = Window.partitionBy(*whole)
    others = lambda c, order: F.last(c, ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    lead = F.min(F.when(F.col("_first").isNotNull(), F.struct("_b", "_first"))).over(w)["_first"]
    return both, ranges.select(*whole, "_b", others("_last", F.col("_b")).alias("_back"), others("_first", F.col("_b").desc()).alias("_ahead"), lead.alias("_lead")), payload


def nearest(left: DataFrame, right: DataFrame, seq: Seq = "lecture_id", left_time: str = "time", right_time: str = "r_time", idx: str = "r_idx", tie: str = "index", span: float = SPAN) -> DataFrame:
    """left with the nearest right row's columns and ``distance`` (null if the sequence has none).

    tie: ``index``, the right row that comes first in list order; ``later``, the one that is later in time.
    """
    both, ranges, payload = _sides(left, right, seq, left_time, right_time, idx, span)
    own = [*keys(seq), "_b"]
    up = Window.partitionBy(*own).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*own).orderBy(F.col("_t").desc(), "_left").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_r", ignorenulls=True)
    seen = both.select("*", last.over(up).alias("_before"), last.over(down).alias("_after")).where("_left = 1").join(ranges.drop("_lead"), own, "left")
    seen = seen.withColumn("_before", F.coalesce("_before", "_back")).withColumn("_after", F.coalesce("_after", "_ahead"))
    d_before, d_after = F.abs(F.col("_t") - F.col(f"_before.{right_time}")), F.abs(F.col(f"_after.{right_time}") - F.col("_t"))
    even = F.col(f"_before.{idx}") <= F.col(f"_after.{idx}") if tie == "index" else F.lit(False)
    first = F.col("_after").isNull() | (d_before < d_after) | ((d_before == d_after) & even)
    picked = seen.withColumn("_pick", F.when(first & F.col("_before").isNotNull(), F.col("_before")).otherwise(F.col("_after")))
    return picked.select("_l.*", *(F.col(f"_pick.{c}").alias(c) for c in payload), F.abs(F.col("_t") - F.col(f"_pick.{right_time}")).alias("distance"))


def as_of(left: DataFrame, right: DataFrame, seq: Seq = "lecture_id", left_time: str = "time", right_time: str = "r_time", idx: str = "r_idx", first_before: bool = False, span: float = SPAN) -> DataFrame:
    """left with the columns of the last right row at or before its time; with first_before, rows that come before all
    take the first. Of right rows with one time, the last in list order counts."""
    flipped = right.withColumn("_flip", -F.col(idx))
    both, ranges, payload = _sides(left, flipped, seq, left_time, right_time, "_flip", span)
    own = [*keys(seq), "_b"]
    up = Window.partitionBy(*own).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_pick", F.last("_r", ignorenulls=True).over(up)).where("_left = 1").join(ranges.drop("_ahead"), own, "left")
    picked = seen.withColumn("_pick", F.coalesce("_pick", "_back", "_lead") if first_before else F.coalesce("_pick", "_back"))
    return picked.select("_l.*", *(F.col(f"_pick.{c}").alias(c) for c in payload if c != "_flip"))


def section_at(rows: DataFrame, sections: DataFrame, seq: str = "lecture_id") -> DataFrame:
    """rows (time) with ``section``: the title of the section (time, title, gt_index) that runs then; the first one
    before all; ``Unassigned Section`` if there is none."""
    right = sections.select(seq, F.col("time").alias("r_time"), F.col("gt_index").alias("r_idx"), F.col("title").alias("section"))
    return as_of(rows, right, seq, first_before=True).withColumn("section", F.coalesce("section", F.lit("Unassigned Section"))).drop("r_time", "r_idx")


def segments(bounds: DataFrame, points: DataFrame, seq: str = "lecture_id") -> DataFrame:
    """seq, segment, start, end (null: the tail), n: points (time) in [previous boundary, boundary), the first segment
    from 0, and a tail from the last boundary on. Points before 0 count for none."""
    w = Window.partitionBy(seq).orderBy("time", "gt_index")
    spans = bounds.select(seq, F.lag("time", 1, 0.0).over(w).alias("start"), F.col("time").alias("end"))
    tails = bounds.groupBy(seq).agg(F.max("time").alias("start")).select(seq, "start", F.lit(None).cast("double").alias("end"))
    every = spans.unionByName(tails)
    numbered = every.withColumn("segment", (F.row_number().over(Window.partitionBy(seq).orderBy("start", F.col("end").asc_nulls_last())) - 1).cast("int"))
    right = numbered.where(F.col("end").isNull() | (F.col("end") > F.col("start"))).select(seq, F.col("start").alias("r_time"), F.col("segment").alias("r_idx"))
    held = as_of(points.where("time >= 0").select(seq, "time"), right, seq).where("r_idx is not null").groupBy(seq, F.col("r_idx").alias("segment")).agg(F.count("*").alias("n"))
    return numbered.join(held, [seq, "segment"], "left").select(seq, "segment", "start", "end", F.coalesce("n", F.lit(0)).alias("n"))


def density(anchors: DataFrame, points: DataFrame, half_width: float, seq: str = "lecture_id") -> DataFrame:
    """anchors (time, gt_index) with n and indices (``;``-joined) of the points (r_time, r_idx) within half_width."""
    found = within(anchors.select(seq, "time", "gt_index"), points.select(seq, "r_time", "r_idx"), half_width, seq)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("r_idx")), lambda x: x.cast("string")), ";")
    counts = found.groupBy(seq, "gt_index").agg(F.count("*").alias("n"), listed.alias("indices"))
    return anchors.join(counts, [seq, "gt_index"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("indices", F.coalesce("indices", F.lit("")))


def lowest_within(anchors: DataFrame, points: DataFrame, distance: float, value: str = "similarity", seq: str = "lecture_id") -> DataFrame:
    """For each anchor (time, gt_index) the point (r_time, r_idx, value) of least value within the distance; first of equals."""
    found = within(anchors.select(seq, "time", "gt_index"), points.select(seq, "r_time", "r_idx", value), distance, seq)
    best = found.groupBy(seq, "gt_index").agg(F.min(F.struct(value, "r_idx", "r_time")).alias("_b"), F.count("*").alias("n"))
    return best.select(seq, "gt_index", f"_b.{value}", "_b.r_idx", "_b.r_time", "n")


def gate(dips: DataFrame, events: DataFrame, distance: Param, reason: str, seq: str = "lecture_id", most: float | None = None) -> DataFrame:
    """Dips (boundary_time) that have an event (time) within the distance, with the new reason. The distance may be a
    column of the dips, of values up to ``most``."""
    right = events.select(seq, F.col("time").alias("r_time"))
    return within(dips, right, distance, seq, "boundary_time", "r_time", "left_semi", most).withColumn("reason", F.lit(reason))


def gate_or(dips: DataFrame, events: DataFrame, slides: DataFrame, distance: float, seq: str = "lecture_id") -> DataFrame:
    """Gated dips, and slide times that have an event within the distance at their own times: no windows, similarity 1."""
    kept = gate(dips, events, distance, "marker_gated_semantic_or_slide", seq)
    aux = within(slides.select(seq, F.col("time").alias("boundary_time")), events.select(seq, F.col("time").alias("r_time")), distance, seq, "boundary_time", "r_time", "left_semi")
    none = F.array(F.lit(-1), F.lit(-1))
    aux = aux.select(seq, "boundary_time", none.alias("between_windows"), F.lit(1.0).alias("similarity"), F.col("boundary_time").alias("left_window_end"), F.col("boundary_time").alias("right_window_start"), F.lit("marker_slide_aux").alias("reason"))
    return kept.unionByName(aux, allowMissingColumns=True)


def anti(rows: DataFrame, matched: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys do not occur in matched."""
    return rows.join(matched.select(*keys).distinct(), list(keys), "left_anti")


def nearest_distance(point: Column, times: Column) -> Column:
    """Least distance of a point to any of an array of times; null without any."""
    return F.array_min(F.transform(times, lambda t: F.abs(t - point)))
