"""Audio, report tables, plots, streams and sinks, on files that the tests write."""

import json
import math
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.plans import experiments as X
from seamline.plans import plots, reports
from seamline.sources import audio, sinks, transcripts


# ---- audio

def write_wav(path, samples, rate, width=2, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(samples.tobytes())


def plain_silence(samples, rate, channels, least, below):
    """Windows of ``least`` ms, one after the other, by a plain loop; ranges of those that are quiet."""
    frames = len(samples) // channels
    length = round(1000 * frames / rate)
    at = lambda ms: min(int(ms * (rate / 1000.0)), frames) * channels
    rms = lambda x: math.floor(math.sqrt(float(np.sum(x.astype(np.int64) ** 2)) / len(x))) if len(x) else 0
    limit = rms(samples) * 10 ** (-below / 20)
    starts = [i for i in range(length - least + 1) if rms(samples[at(i) : at(i + least)]) <= limit]
    out = []
    for i in starts:
        if out and i <= out[-1][1] + least:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a, b + least, (a + b + least) // 2) for a, b in out]


def test_silence_of_frames_of_one_millisecond(spark):
    """A stretch does not depend on the order in which frames of one millisecond come."""
    level = lambda ms: 90.0 if ms % 9000 < 3000 else 10.0
    once = [("a", ms, level(ms)) for ms in range(0, 60_000, 500)]
    both = [("b", ms, x) for ms in range(0, 60_000, 500) for x in ([90.0, 10.0] if ms % 9000 == 6000 else [level(ms)])]
    found = lambda rows: sorted(map(tuple, transcripts.audio_frames_silence(spark.createDataFrame(rows, "seq_id string, ms long, energy double")).collect()))
    assert found(both) == found(both[::-1]) and len(found(both)) == 13
    assert found(once) == found([r for r in once for _ in range(20)]) and len(found(once)) == 7
    frames = spark.createDataFrame([(*r, i) for i, r in enumerate(both)], "seq_id string, ms long, energy double, id long")
    assert sorted(map(tuple, transcripts.audio_frames_silence(frames, ties="id").collect())) != found(both)


@pytest.mark.parametrize(("rate", "channels", "span"), [(8000, 1, 600_000), (11025, 2, 700)])
def test_silence_of_wav_files(spark, tmp_path, rate, channels, span):
    rng = np.random.default_rng(7)
    parts = [(3.0, 9000), (0.6, 40), (1.1, 9000), (0.2, 20), (0.15, 3000), (0.5, 10), (0.7, 9000)]
    made = {}
    for name, seed in (("talk", 0), ("other", 1)):
        x = np.concatenate([rng.normal(0, level, int(sec * rate) * channels) for sec, level in parts[seed:]]).clip(-32768, 32767).astype("<i2")
        write_wav(tmp_path / f"{name}.wav", x, rate, 2, channels)
        made[name] = plain_silence(x, rate, channels, 300, 16.0)
    frames = audio.read_wav(spark, f"file://{tmp_path}/*.wav").cache()
    found = audio.quiet_stretches(frames, 300, 16.0, span).collect()
    assert {(r["seq_id"], r["start_ms"], r["end_ms"], r["mid_ms"]) for r in found} == {(k, *s) for k, v in made.items() for s in v} and len(found) >= 4
    lines = {(r["seq_id"], r["line"]) for r in audio.silence_lines(frames, least_ms=300).collect()}
    stamp = lambda ms: f"{int(ms / 1000 // 60):02d}:{ms / 1000 % 60:05.2f}"
    assert lines == {(k, "00:00.00") for k in made} | {(k, stamp(s[2])) for k, v in made.items() for s in v}
    # written out and read back, they are the silences that a sequence is checked with
    sinks.write_lines(audio.silence_lines(frames, least_ms=300).where("seq_id = 'talk'"), f"file://{tmp_path}/talk_pred.txt", "line", "ms")
    back = sorted(r["time"] for r in transcripts.silences_of(transcripts.lines_of(transcripts.bodies(spark, f"file://{tmp_path}/talk_pred.txt"))).collect())
    assert back == pytest.approx(sorted([0.0, *(round(s[2] / 1000, 2) for s in made["talk"])]), abs=0.0051)


def test_samples_of_other_widths(spark, tmp_path):
    tone = np.sin(np.arange(4000) / 3.0)
    write_wav(tmp_path / "a8.wav", (tone * 100 + 128).astype("<u1"), 4000, 1)
    write_wav(tmp_path / "a32.wav", (tone * 2e9).astype("<i4"), 4000, 4)
    rows = {r["seq_id"]: r for r in audio.read_wav(spark, f"file://{tmp_path}/*.wav").groupBy("seq_id").agg(F.sum("energy").alias("e"), F.count("*").alias("n"), F.sum("samples").alias("s")).collect()}
    assert {k: (r["n"], r["s"]) for k, r in rows.items()} == {"a8": (1000, 4000), "a32": (1000, 4000)}
    assert int(rows["a32"]["e"]) == sum(int(x) ** 2 for x in (tone * 2e9).astype("<i4"))
    with pytest.raises(ValueError, match="not a WAV"):
        list(audio.wav_energy(b"nothing"))
    with pytest.raises(ValueError, match="only PCM"):
        list(audio.wav_energy(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 8000, 32000, 4, 32)))


# ---- report tables

@pytest.fixture
def tables(tmp_path):
    (tmp_path / "expA").mkdir()
    (tmp_path / "expA_summary_table.csv").write_text('Representation,Precision,F1\nSentence,0.5,0.4\nTime,0.25,"n/a"\n')
    (tmp_path / "expA" / "expA_summary_table.csv").write_text("Representation,F1\nOld,0.9\n")
    (tmp_path / "expA" / "expA_summary_table_coarse.csv").write_text('Representation,F1,Remark\nA,0.3,"two\nlines, quoted ""x"""\nB,0.3,\n')
    (tmp_path / "expA" / "expA_summary_table_fine.csv").write_text("Representation,F1\nA,nan\nB, 0.35\n")
    (tmp_path / "expF1_marker_gated_summary_fine.csv").write_text("Setting,window,F1\nx,1,oops\n")
    (tmp_path / "expB_window_size_summary.csv").write_text("Window Size,F1\n")
    return f"file://{tmp_path}"


def test_tables_of_differing_headers(spark, tables):
    rows = reports.read_tables(spark, tables).cache()
    got = {(r["file"], r["row"]): (r["family"], r["table"], r["protocol"], r["header"], r["cells"]) for r in rows.collect()}
    assert got["expA_summary_table.csv", 0] == ("A", "summary_table", None, ["Representation", "Precision", "F1"], {"Representation": "Sentence", "Precision": "0.5", "F1": "0.4"})
    assert ("expA_summary_table.csv", 1) in got and len([k for k in got if k[0] == "expA_summary_table.csv"]) == 2  # the deeper one stands back
    assert got["expA_summary_table_coarse.csv", 0][4]["Remark"] == 'two\nlines, quoted "x"' and got["expA_summary_table_coarse.csv", 1][4]["Remark"] is None
    best = {(r["family"], r["protocol"]): (r["setting"], r["best"]) for r in reports.best_rows(rows).collect()}
    assert best == {("A", None): ("Sentence", 0.4), ("A", "coarse"): ("A", 0.3), ("A", "fine"): ("B", 0.35)}
    both = reports.compare_protocols(reports.best_rows(rows)).collect()
    assert [(r["family"], r["coarse_best"], r["fine_best"], r["shown"], r["gain"]) for r in both] == [("A", 0.3, 0.35, "+0.0500", True)]
    marked = {(r["file"], r["row"], r["column"]) for r in reports.marked_cells(rows).where("best").collect()}
    assert marked == {("expA_summary_table.csv", 0, "F1"), ("expA_summary_table_coarse.csv", 0, "F1"), ("expA_summary_table_coarse.csv", 1, "F1"), ("expA_summary_table_fine.csv", 1, "F1")}
    lines = [r["line"] for r in reports.headlines(reports.best_rows(rows.where("protocol is null")), ["A", "B"]).orderBy("place").collect()]
    assert lines == ["A best: Sentence (F1=0.4)", "B: no data"]


def test_one_side_of_a_comparison_may_lack(spark):
    best = spark.createDataFrame([("A", "t", "coarse", "x", 0.5), ("B", "t", "coarse", "y", 0.5), ("B", "t", "fine", "z", 0.25)], "family string, table string, protocol string, setting string, best double")
    got = {r["family"]: (r["shown"], r["gain"], r["fine_setting"]) for r in reports.compare_protocols(best).collect()}
    assert got == {"A": ("-", False, None), "B": ("-0.2500", False, "z")}
    f1 = spark.createDataFrame([("s", "l1", 0.33335)], "setting string, lecture_id string, f1 double")
    assert reports.reference_deltas(f1, 0.1802).first()["delta"] == pytest.approx(0.1532, abs=1e-4)


# ---- plots

EDGE = "lecture_id string, right_start double, similarity double"


def test_a_thinned_curve_is_short_and_keeps_extremes(spark):
    rng = random.Random(3)
    points = [("a", float(i), rng.random()) for i in range(5000)] + [("b", 7.0, 0.5)]
    got = plots.overview(spark.createDataFrame(points, EDGE), 50).collect()
    own = [(r["x"], r["y"]) for r in got if r["lecture_id"] == "a"]
    assert len(own) <= 200 and set(own) <= {p[1:] for p in points} and {(0.0, points[0][2]), (4999.0, points[4999][2])} <= set(own)
    for k in range(50):
        inside = [p[2] for p in points[:5000] if min(49, int(p[1] / 4999 * 50)) == k]
        shown = [r["y"] for r in got if r["lecture_id"] == "a" and r["column"] == k]
        assert (min(shown), max(shown)) == (min(inside), max(inside))
    assert [(r["column"], r["x"]) for r in got if r["lecture_id"] == "b"] == [(0, 7.0)]


def test_zoom_panels(spark):
    edges = spark.createDataFrame([("a", 10.0 * i, [0.9, 0.2, 0.2, 0.8][i % 4]) for i in range(100)], EDGE)
    truths = spark.createDataFrame([("a", i, float(t), f"t{i}") for i, t in enumerate([100, 400, 700, 5000])], "lecture_id string, gt_index int, time double, time_str string")
    preds = spark.createDataFrame([("a", 95.0), ("a", 61.0), ("a", 390.0)], "lecture_id string, boundary_time double")
    got = {r["gt_index"]: r for r in plots.zoom_panels(edges, truths, preds, 40.0).collect()}
    assert [(got[i]["row"], got[i]["col"], got[i]["rows"]) for i in range(4)] == [(0, 0, 2), (0, 1, 2), (0, 2, 2), (1, 0, 2)]
    assert (got[0]["preds"], got[0]["dip_x"], got[0]["dip_y"]) == ([61.0, 95.0], 60.0, 0.2) and (got[3]["preds"], got[3]["dip_x"]) == ([], None)
    assert {r["gt_index"]: (r["dip_x"], r["dip_y"]) for r in plots.zoom_panels(edges, truths, preds, 40.0, invert=True).collect()}[0] == (80.0, pytest.approx(0.1))
    shown = plots.zoom_curves(edges, truths, 45.0, 90).where("gt_index = 0").orderBy("x").collect()
    assert [(r["column"], r["x"]) for r in shown] == [(-1, 50.0)] + [(x - 55, float(x)) for x in range(60, 150, 10)] + [(90, 150.0)]
    drawn = plots.lines(truths, preds, edges).collect()
    assert {(r["kind"], r["x"], r["label"], r["label_y"]) for r in drawn if r["x"] < 101} == {("truth", 100.0, "t0", 0.9), ("prediction", 95.0, None, None), ("prediction", 61.0, None, None)}
    grouped = plots.bars(spark.createDataFrame([("x", 0, 0.5, None)], "m string, place int, P double, R double"), "m", ["P", "R"], 0.2).collect()
    assert [(r["series"], round(r["left"], 3), r["height"]) for r in grouped] == [("P", -0.2, 0.5), ("R", 0.0, 0.0)]


# ---- sources

def test_captions_as_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "lecture1.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\n<b>Hello</b> you\n\n00:03.000 --> 00:04.500\n[x]\n")
    query = transcripts.cues_of(transcripts.stream_bodies(spark, f"file://{src}"), "strict", drop_empty=True).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").option("path", f"file://{out}").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(f"file://{out}").collect()] == [("lecture1", 0, 1.0, 2.0, "Hello you")]
    assert [tuple(r) for r in transcripts.read_cues(spark, f"file://{src}/*.vtt", "strict", True).collect()] == [("lecture1", 0, 1.0, 2.0, "Hello you")]


def test_bad_clocks_and_missing_files(spark, tmp_path):
    (tmp_path / "l1.vtt").write_text("1 --> 00:02.000\nx\n")
    path = f"file://{tmp_path}/l1.vtt"
    assert transcripts.read_cues(spark, path).first()["start"] is None
    with pytest.raises(Exception, match="not a clock time: 1"):
        transcripts.read_cues(spark, path, strict=True).collect()
    patterns = [f"file://{tmp_path}/{{}}.vtt", f"file://{tmp_path}/{{}}*.vtt"]
    assert transcripts.lectures_with(spark, ["l1", "l2"], *patterns) == ["l1"]
    with pytest.raises(FileNotFoundError, match="l2"):
        transcripts.lectures_with(spark, ["l1", "l2"], *patterns, missing="raise")


# ---- models, counts and sinks

def test_edges_are_kept_by_windowing_and_model(spark, tmp_path):
    windows = spark.createDataFrame([("a", i, float(i), i + 1.0, t) for i, t in enumerate(["x", None, "xyz"])], "lecture_id string, window_id int, start double, end double, text string")
    model = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    one = X.kept_edges(windows, f"file://{tmp_path}/edges", "w1", "count", model)
    assert [round(r["similarity"], 6) for r in one.orderBy("left_window_id").collect()] == [round(1 / math.sqrt(2), 6), round(1 / math.sqrt(10), 6)]
    never = lambda: (_ for _ in ()).throw(RuntimeError("loaded again"))
    again = X.kept_edges(windows, f"file://{tmp_path}/edges", "w1", "count", never)
    assert again.count() == 2 and again.first()["model"] == "count"
    with pytest.raises(Exception, match="loaded again"):
        X.kept_edges(windows, f"file://{tmp_path}/edges", "w1", "other", never)


def test_counts_while_running(spark):
    stages, kept = {}, spark.range(1000).withColumn("lecture_id", F.lit("a"))
    for name, rule in (("all", "true"), ("even", "id % 2 = 0"), ("few", "id < 100")):
        kept, stages[name] = X.observed(kept.where(rule), name)
    assert kept.count() == 50  # the only job
    assert {name: seen.get["rows"] for name, seen in stages.items()} == {"all": 1000, "even": 500, "few": 50}
    same = spark.range(1000).withColumn("lecture_id", F.lit("a"))
    parts = {"all": same, "even": same.where("id % 2 = 0"), "few": same.where("id % 2 = 0 AND id < 100")}
    assert X.stage_counts(parts).first().asDict() == {"lecture_id": "a", "all": 1000, "even": 500, "few": 50}


def test_lines_are_ordered_over_all_files(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id"), F.concat(F.lit("line "), "id").alias("line")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_lines(rows, f"file://{tmp_path}/lines", "line", "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "lines").glob("part-*"))
    assert len(files) > 1 and "".join(f.read_text() for f in files).splitlines() == [f"line {i}" for i in range(5000)]


def test_a_repeated_batch_doubles_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/keyed"
    write = sinks.replace_batches(path, "k")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    for batch, number in ((first, 0), (first, 0), (spark.createDataFrame([("b", 9)], "k string, v int"), 1)):
        write(batch, number)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 2), ("b", 9)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "x.json").write_text(json.dumps({"k": "c", "v": 5}))
    stream = spark.readStream.schema("k string, v int").json(f"file://{src}").writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["a", "a", "b", "c"]
