"""Stateful passes over ordered sequences: spacing, clustering, priority dedup and merging of labelled segments.

A spacing fold compares with the last kept element, so no fixed frame expresses it. But wherever a gap is at least the
spacing, whatever came before no longer matters: sequences are cut there into islands, and each island, which is short
however long its sequence, is folded on its own. A dense sequence, which never leaves such a gap, is one island.

A sequence key may be several columns, and a spacing a column that is the same all over a sequence: a sweep over
spacings is one pass then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CONCEPT_FAMILY
from .keys import Param, Seq, columns_of, keys, value


def islands(rows: DataFrame, gap: Param, seq: Seq, time: str, *ties: str, merge_equal: bool = False, apart: Column | None = None) -> DataFrame:
    """rows with _island: a new one starts where the gap to the row before is at least ``gap`` (more than, if equal
    gaps still merge), or where ``apart``, which may use F.lag over the same window, holds."""
    w = ordered(seq, time, *ties)
    step = F.col(time) - F.lag(time).over(w)
    new = (step > value(gap)) if merge_equal else (step >= value(gap))
    if apart is not None:
        new = new | apart
    return rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def ordered(seq: Seq, time: str, *ties: str):
    return Window.partitionBy(*keys(seq)).orderBy(time, *ties)


def _fold(rows: DataFrame, seq: Seq, time: str, tie: str, distance: Param, better) -> DataFrame:
    """Keep an element at ``distance`` from the last kept; a nearer one replaces it where better(new, kept) holds."""
    cut = islands(rows, distance, seq, time, tie)
    fixed = [*keys(seq), *(c for c in columns_of(distance) if c not in keys(seq))]
    rest = [c for c in rows.columns if c not in (*fixed, time, tie)]
    packed = cut.groupBy(*fixed, "_island").agg(F.array_sort(F.collect_list(F.struct(time, tie, *rest))).alias("_x"))
    kind = packed.schema["_x"].dataType.simpleString()

    def step(kept, x):
        last = F.element_at(kept, -1)
        far = (F.size(kept) == 0) | (x[time] - F.try_element_at(kept, F.lit(-1))[time] >= value(distance))
        added = F.concat(kept, F.array(x))
        if better is None:
            return F.when(far, added).otherwise(kept)
        return F.when(far, added).when(better(x, last), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept)

    folded = packed.select(*fixed, F.explode(F.aggregate("_x", F.array().cast(kind), step)).alias("_k"))
    return folded.select(*(F.col(c) if c in fixed else F.col(f"_k.{c}").alias(c) for c in rows.columns))


def space_first(rows: DataFrame, distance: Param, seq: Seq = "lecture_id", time: str = "time", tie: str = "idx") -> DataFrame:
    """Rows at least ``distance`` after the last kept one; the first of a crowd stays."""
    return _fold(rows, seq, time, tie, distance, None)


def space_strongest(rows: DataFrame, distance: Param, seq: Seq = "lecture_id", time: str = "boundary_time", tie: str = "boundary_index", strength: str = "similarity") -> DataFrame:
    """Spacing in which a strictly lower similarity takes the place (and the time) of the last kept row. A missing
    similarity counts as 1."""
    one = lambda x: F.coalesce(x[strength].cast("double"), F.lit(1.0))
    return _fold(rows, seq, time, tie, distance, lambda x, last: one(x) < one(last))


def gap_clusters(rows: DataFrame, gap: Param, seq: Seq = "lecture_id", time: str = "time", tie: str = "idx") -> DataFrame:
    """seq, cluster, time (mean), n: runs in which each row is within ``gap`` (inclusive) of the one before."""
    cut = islands(rows, gap, seq, time, tie, merge_equal=True)
    return cut.groupBy(*keys(seq), F.col("_island").cast("int").alias("cluster")).agg(F.avg(time).alias("time"), F.count("*").alias("n"))


# ---- labelled segments: rows of time, label, topic, text in order

# A question's class has been split by then, so no question has a priority.
PRIORITY = {"A_Concept_Introduction": 5, "B_Worked_Example": 4, "D_Practical_Important_Point": 3, "C_Explanation_Shift_Major": 2}


def _notes(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" || "), b)


def keep_priority(rows: DataFrame, gap: float = 25.0, seq: Seq = "lecture_id") -> DataFrame:
    """Of segments closer than ``gap`` to the last kept, one of strictly higher priority takes its place; others go."""
    rank = lambda label: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in PRIORITY.items() for v in kv)), label), F.lit(0))
    return _fold(rows, seq, "time", "idx", gap, lambda x, last: rank(x["label"]) > rank(last["label"]))


def _merged(rows: DataFrame, gap: float, seq: Seq, apart: Column, join, merged) -> DataFrame:
    """rows whose neighbours are chained, in islands: where neighbours are further apart than ``gap`` or ``apart`` holds,
    no run goes on, as what a run is joined by is the same for all that is in it."""
    cut = islands(rows, gap, seq, "time", "idx", merge_equal=True, apart=apart)
    packed = cut.groupBy(*keys(seq), "_island").agg(F.array_sort(F.collect_list(F.struct("time", "idx", "label", "topic", "text"))).alias("_x"))
    kind = packed.schema["_x"].dataType.simpleString()

    def step(a, x):
        last = F.try_element_at(a, F.lit(-1))
        pick = {"time": last["time"], "idx": last["idx"], **merged(last, x)}
        both = F.struct(*(pick[c].alias(c) for c in ("time", "idx", "label", "topic", "text")))
        return F.when(F.size(a) == 0, F.array(x)).when(join(last, x), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(both))).otherwise(F.concat(a, F.array(x)))

    whole = F.when(F.size("_x") == 1, F.col("_x")).otherwise(F.aggregate("_x", F.array().cast(kind), step))
    return packed.select(*keys(seq), F.explode(whole).alias("_s")).select(*keys(seq), *(F.col(f"_s.{c}").alias(c) for c in rows.columns if c not in keys(seq)))


def merge_same(rows: DataFrame, gap: float = 90.0, seq: Seq = "lecture_id") -> DataFrame:
    """Successors with the same label and topic within ``gap`` of their run's first time join it."""
    w = ordered(seq, "time", "idx")
    apart = (F.col("label") != F.lag("label").over(w)) | (F.col("topic") != F.lag("topic").over(w))
    return _merged(rows, gap, seq, apart, lambda last, x: x["time"] - last["time"] <= gap, lambda last, x: {"label": last["label"], "topic": last["topic"], "text": _notes(last["text"], x["text"])})


def _is_concept(label: Column) -> Column:
    return F.startswith(label, F.lit("A_"))


def _kind(topic: Column) -> Column:
    """What topics of one family have in common; any other is its own kind."""
    return F.when(topic.isin(CONCEPT_FAMILY), F.lit(CONCEPT_FAMILY[0])).otherwise(topic)


def merge_concepts(rows: DataFrame, gap: float = 240.0, seq: Seq = "lecture_id") -> DataFrame:
    """Concept after concept of one topic or family within ``gap`` of the run's first time: one, named by rule."""
    w = ordered(seq, "time", "idx")
    apart = ~_is_concept(F.col("label")) | ~_is_concept(F.lag("label").over(w)) | (_kind(F.col("topic")) != _kind(F.lag("topic").over(w)))

    def topic(last, x):
        either = (last["topic"] == "AI Definition") | (x["topic"] == "AI Definition")
        return F.when(either, "AI Definition").when(last["topic"].isin(CONCEPT_FAMILY), last["topic"]).otherwise(x["topic"])

    return _merged(rows, gap, seq, apart, lambda last, x: x["time"] - last["time"] <= gap, lambda last, x: {"label": last["label"], "topic": topic(last, x), "text": _notes(last["text"], x["text"])})


def bridge_concepts(rows: DataFrame, gap: float = 180.0, seq: Seq = "lecture_id") -> DataFrame:
    """Concept, minor question, concept within ``gap`` becomes one concept; what comes of it is not looked at again.

    Whether three rows are such is seen from the rows alone. Two of these overlap only if they share a concept, so of a
    run of hits two places apart every other one counts.
    """
    w = ordered(seq, "time", "idx")
    one, two, three = ({c: F.lead(c, k).over(w) if k else F.col(c) for c in ("time", "label", "topic", "text")} for k in range(3))
    hit = _is_concept(one["label"]) & (two["label"] == "E2_Minor_QA") & _is_concept(three["label"]) & (three["time"] - one["time"] <= gap) & (_kind(one["topic"]) == _kind(three["topic"]))
    topic = F.when((one["topic"] == "AI Definition") | (three["topic"] == "AI Definition"), "AI Definition").otherwise(one["topic"])
    found = rows.select("*", F.coalesce(hit, F.lit(False)).alias("_hit"), F.row_number().over(w).alias("_at"), topic.alias("_topic"), _notes(_notes(one["text"], two["text"]), three["text"]).alias("_text"))
    opens = F.col("_hit") & ~F.coalesce(F.lag("_hit", 2).over(w), F.lit(False))
    begun = F.last(F.when(opens, F.col("_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # hits of a run lie two places apart, and no other run can begin between them
    found = found.withColumn("_taken", F.col("_hit") & ((F.col("_at") - begun) % 4 == 0))
    gone = F.coalesce(F.lag("_taken", 1).over(w), F.lit(False)) | F.coalesce(F.lag("_taken", 2).over(w), F.lit(False))
    kept = found.withColumn("_gone", gone).where("not _gone")
    pick = {"label": F.lit("A_Concept_Introduction"), "topic": F.col("_topic"), "text": F.col("_text")}
    return kept.select(*(F.when(F.col("_taken"), pick[c]).otherwise(F.col(c)).alias(c) if c in pick else F.col(c) for c in rows.columns))


def merge_labels(candidates: DataFrame, seq: Seq = "lecture_id", gap: float = 25.0, same_gap: float = 90.0, concept_gap: float = 240.0, bridge_gap: float = 180.0) -> DataFrame:
    """The four passes in turn over candidates (seq, idx, time, label, topic, text): seq, seg_index, time, label, topic, text."""
    rows = candidates.select(*keys(seq), "idx", "time", "label", "topic", "text")
    for step, width in ((keep_priority, gap), (merge_same, same_gap), (merge_concepts, concept_gap), (bridge_concepts, bridge_gap)):
        rows = step(rows, width, seq)
    return rows.select(*keys(seq), F.row_number().over(ordered(seq, "time", "idx")).alias("seg_index"), "time", "label", "topic", "text")
