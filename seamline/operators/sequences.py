"""Sentence units and windows over ordered, time-stamped text.

Every table has its order in a column, and a sequence column that says which rows belong together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences
from .keys import Param, Seq, keys, value

def sentence_units(cues: DataFrame, seq: str = "lecture_id", order: str = "block_id") -> DataFrame:
    """seq, sentence_id, start, end, text: each cue's sentences, with the cue's time shared out by length.

    Times run on from sentence to sentence, and the last one ends when its cue does. A cue without sentences gives none.
    """
    parts = cues.select(seq, order, F.col("start").cast("double").alias("_s"), F.col("end").cast("double").alias("_e"), sentences(F.col("text")).alias("_parts"))
    # what a cue says once is computed once, before it is cut up
    cue = parts.withColumn("_total", F.aggregate("_parts", F.lit(0), lambda a, x: a + F.length(x))).withColumn("_n", F.size("_parts")).withColumn("_cue", F.monotonically_increasing_id())
    rows = cue.select(seq, order, "_s", "_e", "_total", "_n", "_cue", F.posexplode("_parts").alias("_pos", "text"))
    share = (F.col("_e") - F.col("_s")) * (F.length("text").cast("double") / F.col("_total"))
    running = Window.partitionBy(seq, order, "_cue").orderBy("_pos")
    before = F.coalesce(F.sum(share).over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    to = F.when(F.col("_pos") == F.col("_n") - 1, F.col("_e")).otherwise(F.col("_s") + F.sum(share).over(running.rowsBetween(Window.unboundedPreceding, 0)))
    timed = rows.select(seq, order, "_cue", "_pos", (F.col("_s") + before).alias("start"), to.alias("end"), "text")
    number = F.row_number().over(Window.partitionBy(seq).orderBy(order, "_cue", "_pos")) - 1
    return timed.select(seq, number.cast("int").alias("sentence_id"), "start", "end", "text")


def merge_short(units: DataFrame, least: int = 25, seq: str = "lecture_id") -> DataFrame:
    """Units of fewer than ``least`` characters take in what follows until they are long enough; a short last one stays.

    A unit that is long enough by itself ends whatever it is in, so a sequence is cut behind each of these into runs
    that are short however long the sequence (one of short units only is one run). Only lengths are folded over a run: to the places where a group ends.
    """
    w = Window.partitionBy(seq).orderBy("sentence_id")
    size = F.length("text")
    runs = units.withColumn("_run", F.coalesce(F.sum((size >= least).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lengths = runs.groupBy(seq, "_run").agg(F.array_sort(F.collect_list(F.struct("sentence_id", size.alias("n")))).alias("_u"))

    def step(a, x):
        held = F.when(a["held"] < 0, x["n"]).otherwise(a["held"] + 1 + x["n"])
        full = held >= least
        return F.struct(F.when(full, F.concat(a["ends"], F.array(x["sentence_id"]))).otherwise(a["ends"]).alias("ends"), F.when(full, F.lit(-1)).otherwise(held).alias("held"))

    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(-1).alias("held"))
    ends = lengths.select(seq, F.explode(F.aggregate("_u", start, step, lambda a: a["ends"])).alias("sentence_id"), F.lit(1).alias("_end"))
    marked = units.join(ends, [seq, "sentence_id"], "left")
    grouped = marked.withColumn("_group", F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"]), " ")
    rows = grouped.groupBy(seq, "_group").agg(F.min_by("start", "sentence_id").alias("start"), F.max_by("end", "sentence_id").alias("end"), texts.alias("text"))
    return rows.select(seq, F.col("_group").cast("int").alias("sentence_id"), "start", "end", "text")


def sliding_windows(units: DataFrame, width: Param, stride: int = 1, seq: Seq = "lecture_id", most: int | None = None) -> DataFrame:
    """seq, window_id, start, end, sentence_ids, text: every ``stride``-th full window of ``width`` units. The width may
    be a column of up to ``most``: windows of many widths in one pass."""
    most = int(width) if most is None else most
    w = Window.partitionBy(*keys(seq)).orderBy("sentence_id")
    place = F.row_number().over(w) - 1
    size = value(width).cast("int")
    ahead = F.collect_list(F.struct("sentence_id", "start", "end", "text")).over(w.rowsBetween(0, most - 1))
    rows = units.select(*keys(seq), F.slice(ahead, F.lit(1), size).alias("_u"), place.alias("_place"), size.alias("_size"))
    rows = rows.where((F.size("_u") == F.col("_size")) & (F.col("_place") % stride == 0))
    return rows.select(
        *keys(seq),
        (F.col("_place") / stride).cast("int").alias("window_id"),
        F.element_at("_u", 1)["start"].alias("start"),
        F.element_at("_u", -1)["end"].alias("end"),
        F.transform("_u", lambda x: x["sentence_id"]).alias("sentence_ids"),
        F.array_join(F.transform("_u", lambda x: x["text"]), " ").alias("text"),
    )


def tumbling_windows(cues: DataFrame, width: Param, seq: Seq = "lecture_id", order: str = "block_id") -> DataFrame:
    """seq, window_id, start, end, text: windows of ``width`` seconds from the first cue's start to before the last
    cue's end (last in order), each with the texts of the cues that overlap it, in order. Windows without text drop out
    and ids stay dense. A cue is repeated for each window that it overlaps, so this is an equi-join on window numbers.
    The width may be a column that each sequence has one value of.
    """
    whole, size = keys(seq), value(width)
    span = cues.groupBy(*whole).agg(F.min_by("start", order).alias("_t0"), F.max_by("end", order).alias("_t1"))
    rows = cues.join(span, whole).where(F.col("_t1") > F.col("_t0"))
    last = F.ceil((F.col("_t1") - F.col("_t0")) / size) - 1
    # one window either side of the quotient, and the strict predicate below, keep rounding of the quotient harmless
    first_k = F.greatest(F.lit(0), F.floor((F.col("start") - F.col("_t0")) / size) - 1)
    last_k = F.least(last, F.floor((F.col("end") - F.col("_t0")) / size) + 1)
    rows = rows.where(first_k <= last_k).withColumn("_k", F.explode(F.sequence(first_k, last_k)))
    rows = rows.withColumn("_ws", F.col("_t0") + F.col("_k") * size).withColumn("_we", F.col("_ws") + size)
    rows = rows.where((F.col("end") > F.col("_ws")) & (F.col("start") < F.col("_we")) & (F.trim("text") != ""))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    found = rows.groupBy(*whole, "_k").agg(F.first("_ws").alias("start"), F.first("_we").alias("end"), texts.alias("text"))
    number = F.row_number().over(Window.partitionBy(*whole).orderBy("_k")) - 1
    return found.select(*whole, number.cast("int").alias("window_id"), "start", "end", "text")
