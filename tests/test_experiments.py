"""Whole experiments on a small invented lecture: they run, and their figures are those that can be counted by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.operators.embedding import embed
from seamline.operators.signals import adjacent_similarity
from seamline.plans import experiments as X


@pytest.fixture(scope="module")
def lecture(spark):
    texts = {0: "Now what is machine learning, let's define it.", 3: "Um so okay well, uh so it goes.", 6: "Next we take a numpy array for example.", 9: "Keep in mind that gradient descent stops."}
    cues = spark.createDataFrame([("l1", i, 10.0 * i, 10.0 * i + 9, texts.get(i, f"Plain sentence number {i} of the talk.")) for i in range(12)], "lecture_id string, block_id int, start double, end double, text string").cache()
    truths = spark.createDataFrame([("l1", 0, 0.0, "00:00:00", "Start"), ("l1", 1, 60.0, "00:01:00", "Arrays")], "lecture_id string, gt_index int, time double, time_str string, title string").cache()
    slides = spark.createDataFrame([("l1", 58.0)], "lecture_id string, time double")
    return cues, truths, slides


@pytest.fixture(scope="module")
def edges(spark, lecture):
    windows = X.windows_from_cues(lecture[0], size=2)
    return adjacent_similarity(embed(windows, lambda: lambda texts: np.array([[len(t) % 7, len(t) % 5 + 0.1] for t in texts], float))).cache()


def test_windows(lecture, edges):
    assert X.windows_from_cues(lecture[0], size=3).count() == 10
    assert X.windows_from_cues(lecture[0], "time", 30.0).count() == 4
    assert edges.count() == 10 and edges.where("similarity between -1.000001 and 1.000001").count() == 10


def test_fusion(lecture, edges):
    cues, truths, slides = lecture
    got = {r["setting"]: r for r in X.signal_fusion(cues, slides, truths, edges, 20.0, 30.0).collect()}
    assert set(got) == set(X.MODELS)
    assert (got["Marker"]["pred_count"], got["Marker"]["tp"], got["Marker"]["f1"]) == (2, 2, 1.0)
    assert (got["Slide"]["pred_count"], got["Slide"]["tp"]) == (1, 1)


def test_sweeps(lecture, edges):
    cues, truths, _ = lecture
    assert X.rule_ablation(edges, truths, 0.99).count() == 3
    assert X.distance_sweep(edges, truths, [20.0, 45.0], 0.99).count() == 2
    assert {r["setting"] for r in X.gate_sweep(edges, cues, truths, [5.0, 15.0], [0.9], 20.0).collect()} == {"F1_pm5_c09_md20", "F1_pm15_c09_md20"}
    assert X.top_candidates(edges, 3).count() == 3


@pytest.mark.parametrize("rule", ["or", "and"])
def test_gates(lecture, edges, rule):
    cues, _, slides = lecture
    found = X.marker_gated(edges, cues, 0.999, 15.0, 1.0, 0.0, slides, rule).collect()
    assert [r["boundary_index"] for r in sorted(found, key=lambda r: r["boundary_time"])] == list(range(len(found)))
    if rule == "or":
        assert any(r["reason"] == "marker_slide_aux" and r["similarity"] == 1.0 and r["between_windows"] == [-1, -1] for r in found)


def test_draft_boundaries(lecture):
    cues, truths, _ = lecture
    lines = [r["line"] for r in X.draft_boundaries(cues, truths, True).orderBy("seg_index").collect()]
    assert lines[0].split("\t")[:4] == ["00:00:00", "S001", "A_Concept_Introduction", "Start : Machine Learning Concept"]
    assert lines[1].startswith("00:01:00\tS002\tB_Worked_Example\tArrays : NumPy Array Operation\tNext we take a numpy array for example.")


def test_diagnosis(spark, lecture):
    cues, truths, slides = lecture
    preds = spark.createDataFrame([("l1", 0, 2.0, 0.4), ("l1", 1, 15.0, 0.3), ("l1", 2, 110.0, 0.2)], "lecture_id string, pred_index int, time double, similarity double")
    summary = X.alignment_summary(preds, truths, 10.0, 40.0).first()
    assert (summary["tp"], summary["fp"], summary["offset_near_miss"], summary["spurious_far"], summary["max_preds_per_gt"]) == (1, 2, 1, 1, 1)
    rows = {r["pred_index"]: r for r in X.false_positive_review(preds, truths, cues, slides, 10.0, 40.0).collect()}
    assert set(rows) == {1, 2} and rows[2]["rank"] == 1
    assert (rows[1]["nearest_gt_title"], rows[1]["nearest_gt_dist_sec"], rows[1]["fp_bucket"]) == ("Start", 15.0, "offset_near_miss")
    assert rows[1]["snippet"].startswith("[00:00:00–00:00:09] Now what is machine learning") and rows[1]["snippet_block_count"] == 7
    assert (rows[1]["marker_patterns_in_snippet"], rows[1]["slide_near_pred"]) == ("now;next", "no (nearest 43s)")
    assert rows[1]["marker_cue_near_pred"] == "yes Δ=15.0s" and rows[1]["filler_hits_in_snippet"] == 6


def test_silence_and_slides(spark, lecture):
    _, truths, _ = lecture
    silences = spark.createDataFrame([("l1", 1.0), ("l1", 5.0), ("l1", 64.0)], "lecture_id string, time double")
    got = {r["tolerance"]: r["hits"] for r in X.silence_check(truths, silences).collect()}
    assert got == {5.0: 2, 10.0: 2, 15.0: 2}
    log = spark.createDataFrame([("l1", "pts_time:1.5 pts_time:2.0\npts_time:30")], "lecture_id string, value string")
    assert [r["line"] for r in X.slide_changes(log).orderBy("time").collect()] == ["00:00:02", "00:00:30"]


def test_sweeps_from_cues(lecture, edges):
    cues, truths, slides = lecture
    model = lambda windows: embed(windows, lambda: lambda texts: np.array([[len(t) % 7, len(t) % 5 + 0.1] for t in texts], float))
    assert {r["setting"] for r in X.representation_sweep(cues, cues, truths, model, threshold=0.99).collect()} == {"sentence_5", "time_10"}
    assert {r["setting"] for r in X.window_sweep(cues, truths, model, [1, 3], threshold=0.99).collect()} == {"sentence_1", "sentence_3"}
    rows, better = X.prominence_sweep(edges, cues, truths, [0.0, 0.5], threshold=0.999)
    assert rows.count() == 2 and {(r["setting"], r["improved"] + r["worse"] + r["unchanged"]) for r in better.collect()} == {("F2_p00", 1), ("F2_p05", 1)}
    rows, means = X.slide_sweep(edges, cues, slides, truths, 0.25, threshold=0.999)
    assert {r["setting"] for r in rows.collect()} == {"OR20", "OR30", "AND20"}
    assert all(r["delta"] == pytest.approx(r["avg_f1"] - 0.25) for r in means.collect())


def test_versions_of_the_truth_and_silence(spark, lecture):
    _, truths, slides = lecture
    preds = spark.createDataFrame([("a", "l1", 2.0), ("a", "l1", 100.0)], "setting string, lecture_id string, time double")
    detail, means = X.compare_truths(preds, truths, truths.withColumn("time", truths["time"] + 40))
    row = detail.first()
    assert (row["precision_orig"], row["recall_corrected"], row["delta_f1"]) == (0.5, 0.5, 0.0) and means.first()["lectures"] == 1
    segments, near = X.silence_segments(truths, slides)
    assert sum(r["n"] for r in segments.collect()) == 1
    assert {r["gt_index"]: r["signed"] for r in near.collect()} == {0: 58.0, 1: -2.0}
    assert X.stage_counts({"truths": truths, "slides": slides}).first().asDict() == {"lecture_id": "l1", "truths": 2, "slides": 1}
