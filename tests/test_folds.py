"""Folds, matching and joins against the micro cases that fix their semantics, and against plain Python."""

import random

import pytest

from seamline.operators import evaluate as E
from seamline.operators import folds
from seamline.operators import temporal_joins as J


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_strongest_moves_the_reference_time(spark):
    df = rows(spark, [("a", i, float(t), s) for i, (t, s) in enumerate([(0, 0.5), (10, 0.3), (35, 0.9), (36, 0.1)])], "lecture_id string, boundary_index int, boundary_time double, similarity double")
    assert sorted(r["boundary_time"] for r in folds.space_strongest(df, 20.0).collect()) == [10.0, 36.0]


def test_first_stays(spark):
    df = rows(spark, [("a", i, float(t)) for i, t in enumerate([0, 10, 35, 36])], "lecture_id string, idx int, time double")
    assert sorted(r["time"] for r in folds.space_first(df, 20.0).collect()) == [0.0, 35.0]


def test_gap_clusters(spark):
    df = rows(spark, [("a", i, float(t)) for i, t in enumerate([100, 103, 107, 150])], "lecture_id string, idx int, time double")
    assert [round(r["time"], 3) for r in folds.gap_clusters(df, 10.0).orderBy("time").collect()] == [103.333, 150.0]


def fold(points, d, strongest):
    kept = []
    for t, s in sorted(points):
        if not kept or t - kept[-1][0] >= d:
            kept.append((t, s))
        elif strongest and s < kept[-1][1]:
            kept[-1] = (t, s)
    return sorted(t for t, _ in kept)


def test_folds_equal_a_plain_loop(spark):
    rng = random.Random(5)
    data = {k: [(round(rng.uniform(0, 300), 1), rng.random()) for _ in range(60)] for k in "abc"}
    df = rows(spark, [(k, i, t, s) for k, ps in data.items() for i, (t, s) in enumerate(sorted(ps))], "lecture_id string, boundary_index int, boundary_time double, similarity double")
    for strongest, found in ((True, folds.space_strongest(df, 7.0)), (False, folds.space_first(df, 7.0, time="boundary_time", tie="boundary_index"))):
        got = found.collect()
        for k, ps in data.items():
            assert sorted(r["boundary_time"] for r in got if r["lecture_id"] == k) == fold(ps, 7.0, strongest)


P, G = "lecture_id string, pred_index int, time double", "lecture_id string, gt_index int, time double"


@pytest.mark.parametrize(("preds", "truths", "expected"), [([10, 12], [0, 11], {(1, 0), (0, 1)}), ([25, 60], [0, 40], {(1, 0)}), ([], [1, 2, 3], set())])
def test_greedy_match_cases(spark, preds, truths, expected):
    p = rows(spark, [("a", i, float(t)) for i, t in enumerate(preds)], P)
    g = rows(spark, [("a", i, float(t)) for i, t in enumerate(truths)], G)
    assert {(r["gt_index"], r["pred_index"]) for r in E.greedy_match(p, g, 30.0).collect()} == expected


def greedy(preds, truths, tol):
    used, out = set(), set()
    for i, p in enumerate(preds):
        near = [(abs(p - g), k) for k, g in enumerate(truths) if k not in used and abs(p - g) <= tol]
        if near:
            k = min(near)[1]
            used.add(k)
            out.add((k, i))
    return out


def test_greedy_match_equals_a_plain_loop(spark):
    rng = random.Random(6)
    preds = [float(rng.randint(0, 400)) for _ in range(50)]
    truths = [float(rng.randint(0, 400)) for _ in range(40)]
    got = E.greedy_match(rows(spark, [("a", i, t) for i, t in enumerate(preds)], P), rows(spark, [("a", i, t) for i, t in enumerate(truths)], G), 5.0).collect()
    assert {(r["gt_index"], r["pred_index"]) for r in got} == greedy(preds, truths, 5.0)


def test_report_without_predictions(spark):
    r = E.report(rows(spark, [], P), rows(spark, [("a", i, float(i)) for i in range(3)], G)).first()
    assert (r["precision"], r["recall"], r["f1"], r["fn"]) == (0.0, 0.0, 0.0, 3)


@pytest.mark.parametrize(("tie", "expected"), [("index", 4.0), ("later", 6.0)])
def test_nearest_tie(spark, tie, expected):
    left = rows(spark, [("a", 5.0)], "lecture_id string, time double")
    right = rows(spark, [("a", 4.0, 0), ("a", 6.0, 1)], "lecture_id string, r_time double, r_idx int")
    assert J.nearest(left, right, tie=tie).first()["r_time"] == expected


def test_section_falls_back(spark):
    left = rows(spark, [("a", 1.0), ("a", 9.0), ("b", 1.0)], "lecture_id string, time double")
    sections = rows(spark, [("a", 5.0, "first", 0), ("a", 8.0, "second", 1)], "lecture_id string, time double, title string, gt_index int")
    got = {(r["lecture_id"], r["time"]): r["section"] for r in J.section_at(left, sections).collect()}
    assert got == {("a", 1.0): "first", ("a", 9.0): "second", ("b", 1.0): "Unassigned Section"}


def test_overlap_edges(spark):
    cue = rows(spark, [("a", 0.0, 10.0)], "lecture_id string, start double, end double")
    span = rows(spark, [("a", 10.0, 20.0)], "lecture_id string, r_start double, r_end double")
    assert J.overlapping(cue, span, 10.0).count() == 0
    assert J.overlapping(cue, span, 10.0, closed=True).count() == 1


def test_label_merging_equals_a_plain_loop(spark):
    rng = random.Random(8)
    labels = ["A_Concept_Introduction", "B_Worked_Example", "E2_Minor_QA", "D_Practical_Important_Point"]
    topics = ["AI Definition", "Core Concept", "Worked Example"]
    segs, t = [], 0.0
    for i in range(120):
        t += rng.choice([5.0, 20.0, 40.0, 100.0])
        segs.append((t, rng.choice(labels), rng.choice(topics), f"s{i}"))
    got = [tuple(r) for r in folds.merge_labels(rows(spark, [("a", i, *s) for i, s in enumerate(segs)], "lecture_id string, idx int, time double, label string, topic string, text string")).orderBy("seg_index").select("time", "label", "topic", "text").collect()]
    assert got == plain_merge(segs)


def plain_merge(segs):
    family = {"AI Definition", "Concept Definition", "Core Concept", "Machine Learning Concept"}
    same = lambda a, b: a == b or {a, b} <= family
    rank = lambda x: folds.PRIORITY.get(x, 0)
    out = []
    for s in segs:
        if not out or s[0] - out[-1][0] >= 25:
            out.append(s)
        elif rank(s[1]) > rank(out[-1][1]):
            out[-1] = s
    one = []
    for s in out:
        if one and one[-1][1:3] == s[1:3] and s[0] - one[-1][0] <= 90:
            one[-1] = (*one[-1][:3], f"{one[-1][3]} || {s[3]}")
        else:
            one.append(s)
    two = []
    for s in one:
        last = two[-1] if two else None
        if last and last[1][:2] == s[1][:2] == "A_" and same(last[2], s[2]) and s[0] - last[0] <= 240:
            topic = "AI Definition" if "AI Definition" in (last[2], s[2]) else last[2] if last[2] in family else s[2]
            two[-1] = (last[0], last[1], topic, f"{last[3]} || {s[3]}")
        else:
            two.append(s)
    three, i = [], 0
    while i < len(two):
        a, b, c = (two[i : i + 3] + [None] * 3)[:3]
        if c and a[1][:2] == c[1][:2] == "A_" and b[1] == "E2_Minor_QA" and c[0] - a[0] <= 180 and same(a[2], c[2]):
            three.append((a[0], "A_Concept_Introduction", "AI Definition" if "AI Definition" in (a[2], c[2]) else a[2], f"{a[3]} || {b[3]} || {c[3]}"))
            i += 3
        else:
            three.append(a)
            i += 1
    return three


def test_greedy_choices_equal_a_plain_search():
    import random

    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        p = [float(rng.randint(0, 40)) for _ in range(rng.randint(1, 15))]
        truths = sorted((float(rng.randint(0, 40)), i) for i in rng.sample(range(50), rng.randint(1, 15)))
        free, expected = set(range(len(truths))), []
        for t in p:
            near = [(abs(truths[k][0] - t), truths[k][1], k) for k in free if abs(truths[k][0] - t) <= 6]
            expected.append(min(near)[2] if near else -1)
            free.discard(expected[-1])
        assert E._take_nearest(np.array(p), np.array([t for t, _ in truths]), np.array([i for _, i in truths]), 6.0) == expected


def test_dense_matching_is_quick(spark):
    import time

    times = spark.range(2000).selectExpr("'x' as lecture_id", "id * 1.0D as time", "cast(id as int) as pred_index", "cast(id as int) as gt_index")
    E.greedy_match(times.limit(1), times.limit(1)).count()
    began = time.perf_counter()
    assert E.greedy_match(times, times.withColumn("time", times["time"] + 0.4)).count() == 2000
    assert time.perf_counter() - began < 10
