"""Sweeps in one pass give what each setting gives on its own; joins on time give the same however sequences are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.operators import evaluate as E
from seamline.operators import folds, sequences, signals
from seamline.operators import temporal_joins as J
from seamline.operators.embedding import embed
from seamline.operators.keys import with_settings
from seamline.plans import experiments as X


@pytest.fixture(scope="module")
def curve(spark):
    """Edges, markers, slides, truths of three lectures, written, so that a plan shows each scan of them."""
    import tempfile

    rng, at = random.Random(12), tempfile.mkdtemp(prefix="spark-")
    edges = [(k, i, i + 1, 10.0 * i, 10.0 * i + 9, 10.0 * i + 10, 10.0 * i + 19, round(rng.random(), 3)) for k in ("a", "b", "c") for i in range(80)]
    points = lambda n: [(k, i, float(t)) for k in ("a", "b") for i, t in enumerate(sorted(rng.sample(range(800), n)))]
    tables = {
        "edges": spark.createDataFrame(edges, "lecture_id string, left_window_id int, right_window_id int, left_start double, left_end double, right_start double, right_end double, similarity double"),
        "marks": spark.createDataFrame(points(20), "lecture_id string, idx int, time double"),
        "slides": spark.createDataFrame(points(15), "lecture_id string, idx int, time double"),
        "truths": spark.createDataFrame(points(12) + [("c", 0, 100.0)], "lecture_id string, gt_index int, time double"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}")
    return {name: spark.read.parquet(f"{at}/{name}") for name in tables}


def alone(curve, s):
    """One setting by the operators that take numbers."""
    found = signals.dips(curve["edges"], s["threshold"], bool(s.get("need_minimum")), s.get("least_prominence"))
    if s.get("delta") is not None:
        rule = s.get("slide_rule")
        kept = J.gate_or(found, curve["marks"], curve["slides"], s["delta"]) if rule == "or" else J.gate(found, curve["marks"], s["delta"], "gated")
        found = J.gate(kept, curve["slides"], s["slide_window"], "both") if rule == "and" else kept
    found = signals.reindexed(found, "boundary_index", "lecture_id", "boundary_time", "similarity")
    return folds.space_strongest(found, s.get("distance") or 0.0)


SETTINGS = [
    {"setting": "t", "threshold": 0.5},
    {"setting": "m", "threshold": 0.6, "need_minimum": True},
    {"setting": "d", "threshold": 0.9, "need_minimum": True, "distance": 40.0},
    {"setting": "g", "threshold": 0.8, "need_minimum": True, "delta": 12.0, "distance": 30.0, "tolerance": 15.0},
    {"setting": "p", "threshold": 0.8, "need_minimum": True, "least_prominence": 0.2, "delta": 25.0, "distance": 30.0},
    {"setting": "or", "threshold": 0.8, "need_minimum": True, "delta": 12.0, "slide_rule": "or", "slide_window": 20.0, "distance": 30.0},
    {"setting": "and", "threshold": 0.8, "need_minimum": True, "delta": 30.0, "slide_rule": "and", "slide_window": 20.0, "distance": 30.0},
]


def test_boundaries_of_all_settings_are_those_of_each(curve):
    found = X.boundary_sweep(curve["edges"], SETTINGS, curve["marks"], curve["slides"]).collect()
    for s in SETTINGS:
        got = sorted((r["lecture_id"], r["boundary_time"], r["similarity"]) for r in found if r["setting"] == s["setting"])
        assert got == sorted((r["lecture_id"], r["boundary_time"], r["similarity"]) for r in alone(curve, s).collect()) and got


def test_scores_of_all_settings_are_those_of_each(curve):
    found = X.boundary_sweep(curve["edges"], SETTINGS, curve["marks"], curve["slides"]).withColumnRenamed("boundary_time", "time")
    got = {(r["setting"], r["lecture_id"]): tuple(r)[2:] for r in X.score_settings(found, curve["truths"], SETTINGS).collect()}
    assert set(got) == {(s["setting"], k) for s in SETTINGS for k in "abc"}
    for s in SETTINGS:
        own = X._preds(alone(curve, s), "boundary_time", "lecture_id")
        for r in E.report(own, curve["truths"], s.get("tolerance", 30.0)).collect():
            assert got[s["setting"], r["lecture_id"]] == tuple(r)[1:]


def test_a_sweep_scans_its_input_once(curve):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    many = [{"setting": f"s{i}", "threshold": 0.3 + i / 100, "need_minimum": True, "delta": 5.0 + i, "distance": 10.0 + i} for i in range(40)]
    few, all_ = (plan(X.boundary_sweep(curve["edges"], n, curve["marks"])) for n in (many[:1], many))
    scans = lambda text, name: text.count("Relation [") and sum("Relation [" in line and name in line for line in text.splitlines())
    for column in ("similarity", "left_window_id"):
        assert scans(few, column) == scans(all_, column)
    assert all_.count("Relation [") == few.count("Relation [") <= 4  # the curve and the markers, each for rows and for its ranges


def test_experiments_equal_their_settings_alone(spark, curve):
    rows = X.distance_sweep(curve["edges"], curve["truths"], [20.0, 60.0], 0.7).collect()
    for d, name in ((20.0, "d_d20"), (60.0, "d_d60")):
        own = X._preds(X.semantic_boundaries(curve["edges"], 0.7, distance=d), "boundary_time", "lecture_id")
        expected = {r["lecture_id"]: tuple(r)[1:] for r in E.report(own, curve["truths"]).collect()}
        assert {r["lecture_id"]: tuple(r)[2:] for r in rows if r["setting"] == name} == expected
    for rule in ("threshold", "minimum", "minimum+distance"):
        own = X._preds(X.semantic_boundaries(curve["edges"], 0.5, rule, 20.0), "boundary_time", "lecture_id")
        expected = {r["lecture_id"]: tuple(r)[1:] for r in E.report(own, curve["truths"]).collect()}
        assert {r["lecture_id"]: tuple(r)[2:] for r in X.rule_ablation(curve["edges"], curve["truths"], 0.5).collect() if r["setting"] == rule} == expected


@pytest.fixture(scope="module")
def talk(spark):
    """Cues with markers, as they are and cleaned, and what comes of them."""
    rng = random.Random(4)
    says = lambda i: rng.choice(["Now what is machine learning then.", "We go on with a plain sentence here.", "[noise] Next we take an example of it.", "So it goes on."])
    raw = spark.createDataFrame([(k, i, 9.0 * i, 9.0 * i + 8, says(i)) for k in ("a", "b") for i in range(60)], "lecture_id string, block_id int, start double, end double, text string").cache()
    clean = raw.withColumn("text", F.trim(F.regexp_replace("text", r"\[.*?\]", ""))).cache()
    slides = spark.createDataFrame([(k, float(t)) for k in ("a", "b") for t in range(20, 500, 61)], "lecture_id string, time double").cache()
    truths = spark.createDataFrame([(k, i, 83.0 * i) for k in ("a", "b") for i in range(6)], "lecture_id string, gt_index int, time double").cache()
    return raw, clean, slides, truths


def model(windows):
    return embed(windows, lambda: lambda texts: np.array([[len(t) % 7 + 0.1, sum(map(ord, t)) % 5 + 0.1] for t in texts], float))


def test_values_of_gated_sweeps(curve, talk):
    raw, clean, slides, truths = talk
    edges = signals.adjacent_similarity(model(X.windows_from_cues(clean, size=2))).cache()
    rows, better = X.prominence_sweep(edges, clean, truths, [0.0, 0.05], threshold=0.99, delta=20.0)
    got = {(r["setting"], r["lecture_id"]): tuple(r)[2:] for r in rows.collect()}
    expected = {}
    for name, x in (("F2_p00", 0.0), ("F2_p005", 0.05)):
        own = X._preds(X.marker_gated(edges, clean, 0.99, 20.0, least_prominence=x), "boundary_time", "lecture_id")
        expected |= {(name, r["lecture_id"]): tuple(r)[1:] for r in E.report(own, truths).collect()}
    assert got == expected and any(v[0] for v in got.values())
    f1 = lambda name: {k[1]: v[-1] for k, v in expected.items() if k[0] == name}
    change = [f1("F2_p005")[k] - f1("F2_p00")[k] for k in "ab"]
    assert {r["setting"]: (r["improved"], r["worse"], r["unchanged"]) for r in better.collect()}["F2_p005"] == (sum(d > 1e-6 for d in change), sum(d < -1e-6 for d in change), sum(abs(d) <= 1e-6 for d in change))

    rows, means = X.slide_sweep(edges, clean, slides, truths, 0.25, threshold=0.99)
    got = {(r["setting"], r["lecture_id"]): tuple(r)[2:] for r in rows.collect()}
    for rule, window in X.SLIDE_VARIANTS:
        own = X._preds(X.marker_gated(edges, clean, 0.99, slides=slides, slide_rule=rule, slide_window=window), "boundary_time", "lecture_id")
        for r in E.report(own, truths).collect():
            assert got[f"{rule.upper()}{window:g}", r["lecture_id"]] == tuple(r)[1:]
    for r in means.collect():
        four = [round(v[-1], 4) for k, v in got.items() if k[0] == r["setting"]]
        assert r["avg_f1"] == pytest.approx(round(sum(four) / len(four), 4), abs=1e-4) and r["delta"] == pytest.approx(r["avg_f1"] - 0.25)


def test_values_of_window_sweeps(talk):
    raw, clean, _, truths = talk
    settings = [("sentence", 2), ("sentence", 5), ("time", 30.0), ("time", 45.0)]
    windows = X.windows_of_settings(clean, raw, settings)
    for kind, size in settings:
        got = windows.where(F.col("setting") == f"{kind}_{size:g}").select("lecture_id", "window_id", "start", "end", "text")
        own = X.windows_from_cues(raw if kind == "time" else clean, kind, size).select(got.columns)
        assert sorted(got.collect()) == sorted(own.collect()) and own.count()
    assert windows.where("setting like 'time%'").where("text like '%[noise]%'").count() and not windows.where("setting like 'sent%'").where("text like '%[noise]%'").count()
    rows = {(r["setting"], r["lecture_id"]): tuple(r)[2:] for r in X.representation_sweep(clean, raw, truths, model, settings, 0.99).collect()}
    assert len(rows) == 8
    for kind, size in settings:
        edges = signals.adjacent_similarity(model(X.windows_from_cues(raw if kind == "time" else clean, kind, size)))
        own = X._preds(X.semantic_boundaries(edges, 0.99), "boundary_time", "lecture_id")
        for r in E.report(own, truths).collect():
            assert rows[f"{kind}_{size:g}", r["lecture_id"]] == tuple(r)[1:]


def test_spacing_of_zero_and_of_columns(spark):
    df = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate([0, 0, 10, 35, 36])], "lecture_id string, idx int, time double")
    grid = [{"setting": "none", "d": 0.0}, {"setting": "some", "d": 20.0}]
    found = folds.space_first(with_settings(df, grid, "setting string, d double"), "d", ["setting", "lecture_id"]).collect()
    assert sorted((r["setting"], r["time"], r["d"]) for r in found) == [("none", 0.0, 0.0), ("none", 0.0, 0.0), ("none", 10.0, 0.0), ("none", 35.0, 0.0), ("none", 36.0, 0.0), ("some", 0.0, 20.0), ("some", 35.0, 20.0)]
    with pytest.raises(ValueError, match="needs a setting"):
        with_settings(df, [], "setting string")


# ---- sequences cut by time

@pytest.mark.parametrize("span", [7.0, 1000.0])
@pytest.mark.parametrize("tie", ["index", "later"])
def test_nearest_equals_a_plain_search(spark, span, tie):
    rng = random.Random(9)
    left = [(k, float(rng.randint(-50, 150)), i) for k in "abc" for i in range(60)] + [("d", 1.0, 0)]
    right = [(k, float(rng.choice([*range(-40, 20), *range(90, 120)])), i) for k in "ab" for i in range(25)] + [("c", 3.0, 0)]
    found = J.nearest(spark.createDataFrame(left, "lecture_id string, time double, n int"), spark.createDataFrame(right, "lecture_id string, r_time double, r_idx int"), tie=tie, span=span)
    got = {(r["lecture_id"], r["n"]): (r["distance"], r["r_time"], r["r_idx"]) for r in found.collect()}
    assert len(got) == len(left)
    for k, t, n in left:
        near = [(abs(t - u), i if tie == "index" else -u, i, u) for s, u, i in right if s == k]
        d, _, i, u = min(near) if near else (None,) * 4
        assert got[k, n] == (d, u, i)


@pytest.mark.parametrize("span", [7.0, 1000.0])
@pytest.mark.parametrize("first", [True, False])
def test_as_of_equals_a_plain_search(spark, span, first):
    rng = random.Random(10)
    left = [(k, float(rng.randint(-50, 150)), i) for k in "abc" for i in range(60)] + [("d", 1.0, 0)]
    right = [(k, float(rng.choice([*range(-40, 20), *range(90, 120)])), i) for k in "ab" for i in range(25)] + [("c", 30.0, 0)]
    found = J.as_of(spark.createDataFrame(left, "lecture_id string, time double, n int"), spark.createDataFrame(right, "lecture_id string, r_time double, r_idx int"), first_before=first, span=span)
    got = {(r["lecture_id"], r["n"]): (r["r_time"], r["r_idx"]) for r in found.collect()}
    for k, t, n in left:
        own = sorted((u, i) for s, u, i in right if s == k)
        before = [x for x in own if x[0] <= t]
        lead = max((x for x in own if x[0] == own[0][0]), default=(None, None)) if own else (None, None)
        assert got[k, n] == (before[-1] if before else lead if first else (None, None))


def test_one_long_sequence_runs_in_many_tasks(spark):
    left = spark.range(300_000).selectExpr("'x' AS lecture_id", "id * 7.0D AS time", "id AS n")
    right = spark.range(30_000).selectExpr("'x' AS lecture_id", "id * 70.0D + 3 AS r_time", "id AS r_idx")
    found = J.nearest(left, right, span=20_000.0)
    per_range = found.groupBy(F.floor(F.col("time") / 20_000)).count().agg(F.max("count"), F.count("*")).first()
    assert per_range[0] < 3000 and per_range[1] > 100
    check = found.select(F.sum("distance"), F.count("r_idx")).first()
    times = np.arange(300_000) * 7.0
    assert check[1] == 300_000 and check[0] == pytest.approx(np.minimum(np.abs(times - np.clip(np.floor((times - 3) / 70), 0, 29999) * 70 - 3), np.abs(times - np.clip(np.ceil((times - 3) / 70), 0, 29999) * 70 - 3)).sum())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "[lecture_id#" in plan and all("_b#" in line for line in plan.splitlines() if line.strip().lstrip("+-: ").startswith("Window [last(_r"))


def test_labels_are_folded_in_islands_only(spark):
    """A sequence of many labels never becomes one row."""
    segs = spark.range(20_000).selectExpr("'a' AS lecture_id", "cast(id AS int) AS idx", "id * 30.0D AS time", "CASE id % 3 WHEN 0 THEN 'B_Worked_Example' WHEN 1 THEN 'A_Concept_Introduction' ELSE 'E2_Minor_QA' END AS label", "'Core Concept' AS topic", "concat('s', id) AS text")
    assert folds.merge_labels(segs).count() == 20_000
    w = folds.ordered("lecture_id", "time", "idx")
    cut = folds.islands(segs, 90.0, "lecture_id", "time", "idx", merge_equal=True, apart=F.col("label") != F.lag("label").over(w))
    assert cut.groupBy("_island").count().agg(F.max("count")).first()[0] == 1


def test_bridges_take_every_other_hit(spark):
    kinds = {"A": "A_Concept_Introduction", "E": "E2_Minor_QA", "B": "B_Worked_Example"}
    rows = [("a", i, 10.0 * i, kinds[k], "Core Concept", str(i)) for i, k in enumerate("AEAEAEAEABAEAAEAE")]
    got = folds.bridge_concepts(spark.createDataFrame(rows, "lecture_id string, idx int, time double, label string, topic string, text string")).orderBy("time").collect()
    assert [r["text"] for r in got] == ["0 || 1 || 2", "3", "4 || 5 || 6", "7", "8", "9", "10 || 11 || 12", "13 || 14 || 15", "16"]


def test_window_widths_as_a_column(spark):
    units = spark.createDataFrame([("a", i, float(i), i + 1.0, f"u{i}") for i in range(6)], "lecture_id string, sentence_id int, start double, end double, text string")
    many = with_settings(units, [{"setting": "w2", "w": 2}, {"setting": "w5", "w": 5}], "setting string, w int")
    got = sequences.sliding_windows(many, "w", 2, ["setting", "lecture_id"], 5).collect()
    assert sorted((r["setting"], r["window_id"], r["text"]) for r in got) == [("w2", 0, "u0 u1"), ("w2", 1, "u2 u3"), ("w2", 2, "u4 u5"), ("w5", 0, "u0 u1 u2 u3 u4")]
