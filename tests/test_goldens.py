"""Whole chains against files of earlier runs, where a folder of such files is at hand.

SEAMLINE_GOLDENS names a JSON file with globs, each of files named by lecture: cues (*.vtt), sections, truths and drafts
(*_boundaries.txt), slides (*_slides.txt), signal_scores (a CSV file with Model, Lecture, Precision, Recall, F1, Predicted
Boundaries), results (a folder of setting/lecture/*_boundaries.json beside evaluation_report.json, against the truths).
"""

import json
import os

import pytest
from pyspark.sql import functions as F

from seamline.operators import evaluate as E
from seamline.plans import experiments as X
from seamline.sources import transcripts as T

GOLDENS = os.environ.get("SEAMLINE_GOLDENS")
pytestmark = pytest.mark.skipif(not GOLDENS, reason="no folder of earlier runs")


@pytest.fixture(scope="module")
def at():
    with open(GOLDENS) as f:
        return json.load(f)


def test_drafts(spark, at):
    cues, sections = T.read_cues(spark, at["cues"]), T.read_boundaries(spark, at["sections"])
    found: dict[str, list] = {}
    for r in X.draft_boundaries(cues, sections).orderBy("lecture_id", "seg_index").collect():
        found.setdefault(r["lecture_id"], []).append(r["line"])
    told: dict[str, list] = {}
    for r in T.lines_of(T.bodies(spark, at["drafts"], "_boundaries")).where("value != ''").orderBy("lecture_id", "line").collect():
        told.setdefault(r["lecture_id"], []).append(r["value"])
    assert told and found == told


def test_signals(spark, at):
    cues, slides, truths = T.read_cues(spark, at["cues"]), T.read_slides(spark, at["slides"]), T.read_boundaries(spark, at["truths"])
    scores = spark.read.option("header", True).csv(at["signal_scores"]).where(F.col("Model").isin("Marker", "Filler", "Slide")).collect()
    found = {(r["setting"], r["lecture_id"]): r for r in X.signal_fusion(cues, slides, truths).collect()}
    assert scores
    for s in scores:
        r = found[s["Model"], s["Lecture"]]
        assert (r["pred_count"], round(r["precision"], 4), round(r["recall"], 4), round(r["f1"], 4)) == (int(float(s["Predicted Boundaries"])), float(s["Precision"]), float(s["Recall"]), float(s["F1"]))


def test_matches(spark, at):
    case = F.concat_ws("/", "family", "setting", "lecture_id").alias("case")
    family = F.regexp_extract("file_path", r"([^/]+)/[^/]+/lecture[^/]*/[^/]+$", 1)
    preds = T.read_json(spark, at["results"], T.BOUNDARY, "*_boundaries.json").withColumn("family", family)
    folder = r"([^/]+)/(lecture[^/]*)/[^/]+$"
    named = lambda df: df.withColumn("setting", F.regexp_extract("file_path", folder, 1)).withColumn("lecture_id", F.regexp_extract("file_path", folder, 2)).where("lecture_id != ''")
    preds = named(preds).select("lecture_id", case, F.col("boundary_time").alias("time"), F.col("boundary_index").alias("pred_index")).cache()
    reports = named(T.read_json(spark, at["results"], T.REPORT, "evaluation_report.json").withColumn("family", family)).select(case, "*")
    both = reports.join(preds.select("case").distinct(), "case", "left_semi").cache()
    truths = T.read_boundaries(spark, at["truths"]).select("lecture_id", "time", "gt_index").join(preds.select("lecture_id", "case").distinct(), "lecture_id")
    found: dict[str, set] = {}
    for r in E.greedy_match(preds, truths, 30.0, "case").collect():
        found.setdefault(r["case"], set()).add((r["gt_index"], r["pred_index"], round(r["abs_error_sec"], 6)))
    scores = {r["case"]: r for r in E.report(preds, truths, 30.0, "case").collect()}
    rows = both.collect()
    assert rows
    for r in rows:
        assert found.get(r["case"], set()) == {(m["gt_index"], m["pred_index"], round(m["abs_error_sec"], 6)) for m in r["matches"]}
        s = scores[r["case"]]
        assert (s["tp"], s["fp"], s["fn"], s["f1"]) == (r["TP"], r["FP"], r["FN"], pytest.approx(r["f1"], abs=1e-12))
