"""Whole experiments as single plans. A sweep is one pass: what does not depend on a setting (curves, distances to the
nearest cue or slide) is made once, then each row goes on once for each setting that it may pass, with the setting's
parameters as columns and its name as a part of the sequence key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import FILLERS, MARKER_TAGS, cue_count, cue_tags, hms_nearest, proximity_note, setting_id, short_note
from ..operators import evaluate as E
from ..operators import folds, sequences, signals
from ..operators import temporal_joins as J
from ..operators.embedding import embed
from ..operators.keys import once, with_settings

#: Signals that each fused model takes. Fixed values.
MODELS = {
    "Baseline": ["semantic"], "Marker": ["marker"], "Filler": ["filler"], "Slide": ["slide"],
    "+Marker": ["semantic", "marker"], "+Filler": ["semantic", "filler"], "+Slide": ["semantic", "slide"],
    "All": ["semantic", "marker", "filler", "slide"],
}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _preds(rows: DataFrame, time: str, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time)
    return rows.select(*keys, F.col(time).alias("time"), (F.row_number().over(w) - 1).cast("int").alias("pred_index"))


#: Parameters of a setting; those that it does not name are null, and ask for nothing.
SETTING = "setting string, threshold double, need_minimum boolean, least_prominence double, delta double, slide_rule string, slide_window double, distance double, tolerance double"


def score_settings(preds: DataFrame, truths: DataFrame, settings: list[dict] | list[str], tolerance: float = 30.0) -> DataFrame:
    """Reports of every (setting, lecture): the settings are part of the sequence key, so all are one job. preds:
    setting, lecture_id, time. Settings are names, or have a ``tolerance`` of their own."""
    named = [{"setting": s} if isinstance(s, str) else s for s in settings]
    grid = [{"setting": s["setting"], "_tol": tolerance if s.get("tolerance") is None else s["tolerance"]} for s in named]
    kind = "setting string, _tol double"
    key = F.struct("setting", "lecture_id").alias("case")
    many = with_settings(truths.select("lecture_id", "time", "gt_index"), grid, kind).select(key, "time", "gt_index", "_tol")
    within = F.create_map(*(F.lit(v) for g in grid for v in (g["setting"], g["_tol"])))
    w = Window.partitionBy("case").orderBy("time")
    p = preds.select(key, "time", F.element_at(within, F.col("setting")).alias("_tol")).withColumn("pred_index", (F.row_number().over(w) - 1).cast("int"))
    return E.report(p, many, "_tol", "case").select("case.*", "pred_count", "gt_count", "tp", "fp", "fn", "precision", "recall", "f1")


def boundary_sweep(edges: DataFrame, settings: list[dict], marks: DataFrame | None = None, slides: DataFrame | None = None, span: int = 1) -> DataFrame:
    """setting, lecture_id, boundary_time, similarity: the boundaries of every setting (see SETTING), from one scan of
    the edges, one of the markers (time) and one or two of the slides (time).

    A dip is under the threshold, a local minimum if need_minimum, of least_prominence, within delta of a marker, and
    with slide_rule ``and`` within slide_window of a slide; with ``or`` slides within delta of a marker join in with
    similarity 1. Boundaries are spaced by distance (the strongest of a crowd stays), or not at all.
    """
    rows = signals.shaped(edges, span).where(F.col("similarity") < max(s["threshold"] for s in settings))
    rows = rows.select("lecture_id", F.col("right_start").alias("boundary_time"), "similarity", "_minimum", "prominence")
    near = lambda rows, events, name: J.nearest(rows, events.select("lecture_id", F.col("time").alias("r_time"), F.lit(0).alias("r_idx")), left_time="boundary_time").drop("r_time", "r_idx").withColumnRenamed("distance", name)
    met = F.col("similarity") < F.col("threshold")
    met &= ~F.coalesce("need_minimum", F.lit(False)) | F.col("_minimum")
    met &= F.col("least_prominence").isNull() | (F.col("prominence") >= F.col("least_prominence") - 1e-12)
    if any(s.get("delta") is not None for s in settings):
        rows = near(rows, marks, "_mark")
        met &= F.col("delta").isNull() | (F.col("_mark") <= F.col("delta"))
    if any(s.get("slide_rule") == "and" for s in settings):
        rows = near(rows, slides, "_slide")
        met &= F.col("slide_rule").isNull() | (F.col("slide_rule") == "or") | (F.col("_slide") <= F.col("slide_window"))
    kept = with_settings(rows, settings, SETTING).where(met).select("setting", "lecture_id", "boundary_time", "similarity", "distance")
    if extra := [s for s in settings if s.get("slide_rule") == "or"]:
        aux = near(slides.select("lecture_id", F.col("time").alias("boundary_time")), marks, "_mark")
        aux = with_settings(aux.drop("distance"), extra, SETTING).where(F.col("_mark") <= F.col("delta"))
        kept = kept.unionByName(aux.select("setting", "lecture_id", "boundary_time", F.lit(1.0).alias("similarity"), "distance"))
    kept = kept.withColumn("distance", F.coalesce("distance", F.lit(0.0)))  # at a distance of 0 all stay
    whole = ["setting", "lecture_id"]
    kept = signals.reindexed(kept, "boundary_index", whole, "boundary_time", "similarity")
    return folds.space_strongest(kept, "distance", whole).select(*whole, "boundary_time", "similarity")


def _swept(edges: DataFrame, truths: DataFrame, settings: list[dict], tolerance: float, marks: DataFrame | None = None, slides: DataFrame | None = None) -> DataFrame:
    found = boundary_sweep(edges, settings, marks, slides).select("setting", "lecture_id", F.col("boundary_time").alias("time"))
    return score_settings(found, truths, settings, tolerance)


def marks_of(cues: DataFrame, distance: float = 20.0) -> DataFrame:
    """Marker times, spaced."""
    return folds.space_first(signals.marker_times(cues), distance)


def windows_from_cues(cues: DataFrame, representation: str = "sentence", size: float = 5, min_chars: int = 25, stride: int = 1) -> DataFrame:
    """Sentence windows (of strictly cleaned cues) or time windows (of raw cues)."""
    if representation == "time":
        return sequences.tumbling_windows(cues, float(size))
    return sequences.sliding_windows(sequences.merge_short(sequences.sentence_units(cues), min_chars), int(size), stride)


def semantic_boundaries(edges: DataFrame, threshold: float = 0.55, rule: str = "minimum+distance", distance: float = 20.0) -> DataFrame:
    """The rules' variants: ``threshold``, ``minimum``, ``minimum+distance``."""
    found = signals.dips(edges, threshold, rule != "threshold")
    if rule.endswith("distance"):
        found = signals.reindexed(folds.space_strongest(found, distance), "boundary_index", "lecture_id", "boundary_time")
    return found


def distance_sweep(edges: DataFrame, truths: DataFrame, distances: list[float], threshold: float = 0.55, tolerance: float = 30.0) -> DataFrame:
    return _swept(edges, truths, [{"setting": setting_id("d", d=d), "threshold": threshold, "need_minimum": True, "distance": d} for d in distances], tolerance)


def rule_ablation(edges: DataFrame, truths: DataFrame, threshold: float = 0.55, distance: float = 20.0, tolerance: float = 30.0) -> DataFrame:
    rules = {"threshold": {}, "minimum": {"need_minimum": True}, "minimum+distance": {"need_minimum": True, "distance": distance}}
    return _swept(edges, truths, [{"setting": r, "threshold": threshold, **how} for r, how in rules.items()], tolerance)


def signal_times(cues: DataFrame, slides: DataFrame, edges: DataFrame | None = None, distance: float = 20.0, threshold: float = 0.55) -> DataFrame:
    """lecture_id, signal, time of the four signals, each spaced on its own."""
    spaced = lambda rows, name: folds.space_first(rows, distance).select("lecture_id", F.lit(name).alias("signal"), "time")
    w = Window.partitionBy("lecture_id").orderBy("time")
    slide_rows = slides.select("lecture_id", "time", F.row_number().over(w).alias("idx"))
    found = [spaced(signals.marker_times(cues), "marker"), spaced(signals.filler_peaks(cues).drop("fillers"), "filler"), spaced(slide_rows, "slide")]
    if edges is not None:
        found.append(semantic_boundaries(edges, threshold, distance=distance).select("lecture_id", F.lit("semantic").alias("signal"), F.col("boundary_time").alias("time")))
    return _union(found)


def fuse(times: DataFrame, models: dict[str, list[str]] = MODELS, distance: float = 20.0) -> DataFrame:
    """setting, lecture_id, time: each model's signals together, spaced anew (the first of a crowd stays)."""
    masks = times.sparkSession.createDataFrame([(m, s) for m, names in models.items() for s in names], "setting string, signal string")
    rows = times.join(F.broadcast(masks), "signal").select(F.struct("setting", "lecture_id").alias("case"), "time")  # as many rows as models have signals
    w = Window.partitionBy("case").orderBy("time")
    spaced = folds.space_first(rows.withColumn("idx", F.row_number().over(w)), distance, "case")
    return spaced.select("case.*", "time")


def signal_fusion(cues: DataFrame, slides: DataFrame, truths: DataFrame, edges: DataFrame | None = None, distance: float = 20.0, tolerance: float = 30.0) -> DataFrame:
    """Reports of all fused models; those with the semantic signal need edges."""
    models = {m: s for m, s in MODELS.items() if edges is not None or "semantic" not in s}
    found = fuse(signal_times(cues, slides, edges, distance), models, distance)
    return score_settings(found, truths, list(models), tolerance)


def marker_gated(edges: DataFrame, cues: DataFrame, threshold: float = 0.6, delta: float = 15.0, distance: float = 30.0, least_prominence: float | None = None, slides: DataFrame | None = None, slide_rule: str = "or", slide_window: float = 20.0, marker_distance: float = 20.0) -> DataFrame:
    """Dips with a marker nearby, by choice of some prominence, by choice with slides (``or``: slide times that have a
    marker nearby join in, whatever slide_window; ``and``: a slide within slide_window is needed too), then spaced."""
    found = signals.dips(edges, threshold, least_prominence=least_prominence)
    marks = marks_of(cues, marker_distance)
    reason = "marker_gated_semantic" if least_prominence is None else "marker_gated_prominence_semantic"
    if slides is None:
        kept = J.gate(found, marks, delta, reason)
    elif slide_rule == "or":
        kept = J.gate_or(found, marks, slides, delta)
    else:
        kept = J.gate(J.gate(found, marks, delta, reason), slides, slide_window, "marker_gated_semantic_and_slide")
    kept = signals.reindexed(kept, "boundary_index", "lecture_id", "boundary_time", "similarity")
    return signals.reindexed(folds.space_strongest(kept, distance), "boundary_index", "lecture_id", "boundary_time")


def gate_sweep(edges: DataFrame, cues: DataFrame, truths: DataFrame, deltas: list[float], thresholds: list[float], distance: float = 30.0, tolerance: float = 30.0) -> DataFrame:
    settings = [{"setting": setting_id("F1", pm=d, c=t, md=distance), "threshold": t, "need_minimum": True, "delta": d, "distance": distance} for d in deltas for t in thresholds]
    return _swept(edges, truths, settings, tolerance, marks_of(cues))


def draft_labels(cues: DataFrame) -> DataFrame:
    """lecture_id, idx, time, label, topic, text of the cues that have a class."""
    rows = cues.select("lecture_id", F.col("block_id").alias("idx"), F.col("start").alias("time"), "text")
    rows = once(once(rows, **{"class": L.cue_class(F.col("text"))}).where("class is not null"), raw=L.topic(F.col("text")))
    rows = once(rows, label=L.question_value(F.col("class"), F.col("text"), F.col("raw")))
    return rows.select("lecture_id", "idx", "time", "label", L.schema_topic(F.col("label"), F.col("raw"), F.col("text")).alias("topic"), "text")


def draft_boundaries(cues: DataFrame, sections: DataFrame, with_text: bool = False) -> DataFrame:
    """lecture_id, seg_index, line: draft fine annotations, each under the section that runs at its time."""
    merged = folds.merge_labels(draft_labels(cues))
    placed = J.section_at(merged, sections)
    parts = [hms_nearest(F.col("time")), F.format_string("S%03d", "seg_index"), F.col("label"), F.concat_ws(" : ", "section", "topic")]
    return placed.select("lecture_id", "seg_index", F.concat_ws("\t", *parts, *([short_note(F.col("text"))] if with_text else [])).alias("line"))


def snippets(points: DataFrame, cues: DataFrame, before: float = 45.0, after: float = 45.0) -> DataFrame:
    """points (lecture_id, pred_index, time) with ``snippet`` (cues that touch the span around, each with its times) and
    ``snippet_block_count``."""
    spans = points.select("lecture_id", "pred_index", (F.col("time") - before).alias("r_start"), (F.col("time") + after).alias("r_end"))
    hit = J.overlapping(cues.where(F.col("text") != ""), spans, before + after, closed=True)
    piece = F.concat(F.lit("["), hms_nearest(F.col("start")), F.lit("–"), hms_nearest(F.col("end")), F.lit("] "), F.col("text"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", piece.alias("s")))), lambda x: x["s"]), " ")
    found = hit.groupBy("lecture_id", "pred_index").agg(texts.alias("snippet"), F.count("*").alias("snippet_block_count"))
    return points.join(found, ["lecture_id", "pred_index"], "left").na.fill("", ["snippet"]).na.fill(0, ["snippet_block_count"])


def false_positive_review(preds: DataFrame, truths: DataFrame, cues: DataFrame, slides: DataFrame, tolerance: float = 30.0, middle: float = 120.0, bucket: str = "all", most: int = 30, hint: float = 20.0, marker_window: float = 15.0) -> DataFrame:
    """The ``most`` farthest false positives (of a bucket) of each lecture, with snippet, cue counts and proximity notes."""
    found = E.false_positives(preds, truths, tolerance, middle)
    if bucket != "all":
        found = found.where(F.col("fp_bucket") == bucket)
    w = Window.partitionBy("lecture_id").orderBy(F.col("distance").desc(), "pred_index")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, most))
    rows = snippets(found, cues)
    marks = signals.marker_times(cues).select("lecture_id", F.col("time").alias("r_time"), F.col("idx").alias("r_idx"))
    slide_rows = slides.select("lecture_id", F.col("time").alias("r_time"), F.lit(0).alias("r_idx"))
    titled = truths.select("lecture_id", F.col("gt_index").alias("r_idx"), *(F.col(c).alias(f"nearest_gt_{c}") for c in ("time_str", "title") if c in truths.columns))
    rows = rows.join(titled, ["lecture_id", "r_idx"], "left").drop("r_time", "r_idx").withColumnRenamed("distance", "nearest_gt_dist_sec")
    rows = J.nearest(rows, marks).drop("r_time", "r_idx").withColumnRenamed("distance", "_mark")
    rows = J.nearest(rows, slide_rows).drop("r_time", "r_idx").withColumnRenamed("distance", "_slide")
    return rows.select(
        "*", hms_nearest(F.col("time")).alias("pred_time_hms"), cue_count(F.col("snippet"), FILLERS).alias("filler_hits_in_snippet"),
        cue_tags(F.col("snippet"), MARKER_TAGS).alias("marker_patterns_in_snippet"), proximity_note(F.col("_mark"), marker_window).alias("marker_cue_near_pred"),
        proximity_note(F.col("_slide"), hint).alias("slide_near_pred"),
    ).drop("_mark", "_slide")


def alignment_summary(preds: DataFrame, truths: DataFrame, tolerance: float = 30.0, middle: float = 120.0) -> DataFrame:
    """Per lecture: counts, false-positive buckets with percentages, mean and greatest number of predictions near a truth."""
    counts = E.report(preds, truths, tolerance)
    shares = E.bucket_shares(E.false_positives(preds, truths, tolerance, middle)).drop("fp")
    points = preds.select("lecture_id", F.col("time").alias("r_time"), F.col("pred_index").alias("r_idx"))
    dense = J.density(truths, points, tolerance).groupBy("lecture_id").agg(F.avg("n").alias("mean_preds_per_gt"), F.max("n").alias("max_preds_per_gt"))
    return counts.join(shares, "lecture_id", "left").join(dense, "lecture_id", "left").na.fill(0)


def silence_check(truths: DataFrame, silences: DataFrame, gap: float | None = 10.0, tolerances: tuple[float, ...] = (5.0, 10.0, 15.0)) -> DataFrame:
    """Hit rates of silence times, raw or clustered by gaps of at most ``gap``."""
    w = Window.partitionBy("lecture_id").orderBy("time")
    rows = silences.select("lecture_id", "time", F.row_number().over(w).alias("idx"))
    if gap is not None:
        rows = folds.gap_clusters(rows, gap)
    return E.hit_rates(truths, _preds(rows, "time", "lecture_id"), list(tolerances))


def slide_changes(log: DataFrame, distance: float = 20.0) -> DataFrame:
    """lecture_id, time, line (HH:MM:SS) of scene changes, spaced."""
    from ..sources.transcripts import scene_times

    w = Window.partitionBy("lecture_id").orderBy("time")
    rows = scene_times(log).select("lecture_id", "time", F.row_number().over(w).alias("idx"))
    return folds.space_first(rows, distance).select("lecture_id", "time", hms_nearest(F.col("time")).alias("line"))


def top_candidates(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` lowest similarities of each lecture."""
    w = Window.partitionBy("lecture_id").orderBy("similarity", "left_window_id")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


# ---- sweeps from cues to tables of results

def windows_of_settings(cues: DataFrame, raw_cues: DataFrame, settings: list[tuple[str, float]], min_chars: int = 25) -> DataFrame:
    """Windows of every (representation, size), with setting (``sentence_5``): all sizes of sentence windows are one pass
    over the units of cues, all sizes of time windows one over the raw cues."""
    grid = lambda kind: [{"setting": f"{kind}_{size:g}", "_size": size} for k, size in settings if k == kind]
    whole, found = ["setting", "lecture_id"], []
    if own := grid("sentence"):
        units = sequences.merge_short(sequences.sentence_units(cues), min_chars)
        found.append(sequences.sliding_windows(with_settings(units, own, "setting string, _size double"), "_size", seq=whole, most=int(max(s["_size"] for s in own))))
    if own := grid("time"):
        found.append(sequences.tumbling_windows(with_settings(raw_cues, own, "setting string, _size double"), "_size", whole))
    return _union(found)


def representation_sweep(cues: DataFrame, raw_cues: DataFrame, truths: DataFrame, embed: Callable[[DataFrame], DataFrame], settings: list[tuple[str, float]] | None = None, threshold: float = 0.55, distance: float = 20.0, tolerance: float = 30.0) -> DataFrame:
    """Reports of each representation and size: windows, edges, dips, spacing, matching. Sentence windows are of cues,
    which are cleaned; time windows are of raw cues. embed gives windows their embeddings, of all settings at once."""
    settings = settings or [("sentence", 5), ("time", 10.0)]
    whole = ["setting", "lecture_id"]
    edges = signals.adjacent_similarity(embed(windows_of_settings(cues, raw_cues, settings)), whole)
    dips = signals.dips(edges, threshold, seq=whole)
    found = folds.space_strongest(dips.select(*whole, "boundary_time", "boundary_index", "similarity"), distance, whole)
    return score_settings(found.select(*whole, F.col("boundary_time").alias("time")), truths, [f"{kind}_{size:g}" for kind, size in settings], tolerance)


def window_sweep(cues: DataFrame, truths: DataFrame, embed: Callable[[DataFrame], DataFrame], sizes: list[int] | None = None, **how: float) -> DataFrame:
    """Reports of sentence windows of each size."""
    return representation_sweep(cues, cues, truths, embed, [("sentence", n) for n in sizes or [1, 3, 5, 7, 10]], **how)


def prominence_sweep(edges: DataFrame, cues: DataFrame, truths: DataFrame, least: list[float] | None = None, tolerance: float = 30.0, threshold: float = 0.6, delta: float = 15.0, distance: float = 30.0, marker_distance: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Reports of gated dips for each least prominence, and how many lectures each improves on the first."""
    settings = [{"setting": setting_id("F2", p=x), "threshold": threshold, "need_minimum": True, "least_prominence": x, "delta": delta, "distance": distance} for x in least or [0.0, 0.02, 0.04, 0.06, 0.08]]
    rows = _swept(edges, truths, settings, tolerance, marks_of(cues, marker_distance))
    return rows, E.improvements(rows, rows.where(F.col("setting") == settings[0]["setting"]), "setting")


#: Slide variants: rule and distance of slides. Fixed values.
SLIDE_VARIANTS = [("or", 20.0), ("or", 30.0), ("and", 20.0)]


def slide_sweep(edges: DataFrame, cues: DataFrame, slides: DataFrame, truths: DataFrame, reference_f1: float, variants: list[tuple[str, float]] | None = None, tolerance: float = 30.0, threshold: float = 0.6, delta: float = 15.0, distance: float = 30.0, marker_distance: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Reports of each way to join slides in, and each one's macro average with its difference to a reference F1."""
    gate = {"threshold": threshold, "need_minimum": True, "delta": delta, "distance": distance}
    settings = [{"setting": f"{rule.upper()}{window:g}", "slide_rule": rule, "slide_window": window, **gate} for rule, window in variants or SLIDE_VARIANTS]
    rows = _swept(edges, truths, settings, tolerance, marks_of(cues, marker_distance), slides)
    return rows, delta_to(E.macro_average(rows, "setting"), "avg_f1", reference_f1)


def delta_to(rows: DataFrame, value: str, reference: float) -> DataFrame:
    """rows with ``delta``: how far a value lies over a reference, to 4 digits."""
    return rows.withColumn("delta", F.round(F.col(value) - F.lit(reference), 4))


def stage_counts(stages: dict[str, DataFrame], seq: str = "lecture_id") -> DataFrame:
    """A row per sequence, a column per stage: how many rows of the stage it has, 0 where it has none."""
    long = _union([rows.select(seq, F.lit(name).alias("stage")) for name, rows in stages.items()])
    return long.groupBy(seq).pivot("stage", list(stages)).count().na.fill(0, list(stages))


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows, and how many there were (``.get["rows"]``) once whatever uses them has run: no pass of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def kept_edges(windows: DataFrame, path: str, windowing: str, model: str, make_model: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Edges of windows by a model, with windowing and model: made once and kept under the path by those two names, read
    from there ever after."""
    from ..sources import sinks, transcripts

    spark = windows.sparkSession
    place = f"{path.rstrip('/')}/windowing={windowing}/model={model}"
    if not transcripts.exists(spark, f"{place}/_SUCCESS"):
        sinks.write_vectors(signals.adjacent_similarity(embed(windows, make_model)), place)
    return spark.read.parquet(place).select(F.lit(windowing).alias("windowing"), F.lit(model).alias("model"), "*")


def compare_truths(preds: DataFrame, old: DataFrame, new: DataFrame, tolerance: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Predictions (setting, lecture_id, time) under two versions of the truth: metrics side by side with differences
    for each setting and lecture, and their means for each setting."""
    settings = sorted(r["setting"] for r in preds.select("setting").distinct().collect())  # a sweep's names
    detail = E.compare_versions(*(score_settings(preds, t, settings, tolerance) for t in (old, new)), "setting", "lecture_id")
    means = [F.avg(c).alias(c) for c in detail.columns if c not in ("setting", "lecture_id")]
    return detail, detail.groupBy("setting").agg(F.count("*").alias("lectures"), *means)


def silence_segments(truths: DataFrame, silences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Silences in each segment between truths, and for each truth the nearest silence with its signed distance."""
    right = silences.select("lecture_id", F.col("time").alias("r_time"), F.row_number().over(Window.partitionBy("lecture_id").orderBy("time")).alias("r_idx"))
    near = J.nearest(truths, right, tie="later").withColumn("signed", F.col("r_time") - F.col("time"))
    return J.segments(truths, silences), near.select("lecture_id", "gt_index", "time", F.col("r_time").alias("silence"), "signed")
