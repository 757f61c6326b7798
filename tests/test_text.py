"""Readers, text functions and signals on small files and the semantics that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.functions.vectors import cosine
from seamline.operators import sequences, signals
from seamline.sources import sinks, transcripts

VTT = "WEBVTT\r\n\r\n00:00:01.500 --> 00:00:04.000\r\n<v Speaker 0>Hello there. This is [noise] fine.\r\n\r\nNOTE CONF {\"raw\":[1]}\r\n\r\n7\r\n00:05.000 --> 00:07,250\r\nSecond line\r\nof text\r\n\r\n00:00:08.000 --> 00:00:09.000\r\n[music]\r\n"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture
def vtt(tmp_path):
    (tmp_path / "lecture1.vtt").write_bytes(VTT.encode())
    return f"file://{tmp_path}/*.vtt"


def test_cue_variants(spark, vtt):
    got = [tuple(r) for r in transcripts.read_cues(spark, vtt, "strict", drop_empty=True).orderBy("block_id").collect()]
    assert got == [("lecture1", 0, 1.5, 4.0, "Hello there. This is fine."), ("lecture1", 1, 5.0, 7.25, "Second line of text")]
    assert [r["text"] for r in transcripts.read_cues(spark, vtt, "tags").orderBy("block_id").collect()] == ["Hello there. This is [noise] fine.", "Second line of text", "[music]"]
    assert transcripts.read_cues(spark, vtt, "none").orderBy("block_id").first()["text"].startswith("<v Speaker 0>")


def test_boundary_files(spark, tmp_path):
    (tmp_path / "lecture2_boundaries.txt").write_text("00:05:36  Title one \nnot a line\n00:00:10\tS001\tB_Worked_Example\tPart : Topic")
    got = [tuple(r) for r in transcripts.read_boundaries(spark, f"file://{tmp_path}/*_boundaries.txt").orderBy("gt_index").collect()]
    assert got[0] == ("lecture2", 0, 336.0, "00:05:36", "Title one")
    fine = transcripts.read_fine_boundaries(spark, f"file://{tmp_path}/*_boundaries.txt").where("gt_index = 1").first()
    assert (fine["seg_id"], fine["label"], fine["section"], fine["topic"]) == ("S001", "B_Worked_Example", "Part", "Topic")


def test_event_files(spark, tmp_path):
    (tmp_path / "lecture1_slides.txt").write_text("# note\n\n00:21:14 shown\n")
    (tmp_path / "lecture1_pred.txt").write_text("00:00.00\n01:01.999\n")
    assert [r["time"] for r in transcripts.read_slides(spark, f"file://{tmp_path}/*_slides.txt").collect()] == [1274.0]
    assert sorted(r["time"] for r in transcripts.read_silences(spark, f"file://{tmp_path}/*_pred.txt").collect()) == [0.0, 61.99]
    log = spark.createDataFrame([("a", "x pts_time:12.5 y\nz pts_time:3"), ("a", "pts_time:12.5")], "lecture_id string, value string")
    assert sorted(r["time"] for r in transcripts.scene_times(log).collect()) == [3.0, 12.5]


def test_clock(spark):
    assert one(spark, X.clock_seconds(F.lit("01:02:03,5"))) == 3723.5
    assert one(spark, X.clock_seconds(F.lit("02:03.5"))) == 123.5
    assert one(spark, X.clock_seconds(F.lit("5"))) is None
    assert one(spark, X.hms_nearest(F.lit(2.5))) == "00:00:02"
    assert one(spark, X.hms_nearest(F.lit(3.5))) == "00:00:04"
    assert one(spark, X.hms_floor(F.lit(3599.9))) == "00:59:59"
    assert one(spark, X.minutes_centis(F.lit(61.99))) == "01:01.99"


def test_small_functions(spark):
    assert one(spark, X.cue_tags(F.lit("Now let's move on, today we will"))) == "now;move_on;today_we;lets_move_on"
    assert one(spark, X.proximity_note(F.lit(8.24), 20.0)) == "yes Δ=8.2s"
    assert one(spark, X.proximity_note(F.lit(None).cast("double"), 20.0)) == "no"
    assert one(spark, X.short_note(F.lit("a" * 90))) == "a" * 77 + "..."
    assert one(spark, X.html_escape(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, X.exact_round(F.lit(0.00005), 4)) == 0.0001 or one(spark, X.exact_round(F.lit(0.00005), 4)) == 0.0
    assert X.setting_id("F1", pm=15.0, c=0.6, md=30.0) == "F1_pm15_c06_md30"
    assert one(spark, X.safe_double(F.lit("x"), 0.0)) == 0.0
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_short_units_merge(spark):
    units = spark.createDataFrame([("a", 0, 0.0, 1.0, "x" * 30), ("a", 1, 1.0, 2.0, "ok")], "lecture_id string, sentence_id int, start double, end double, text string")
    assert [r["text"] for r in sequences.merge_short(units).orderBy("sentence_id").collect()] == ["x" * 30, "ok"]


def test_plateaus(spark):
    low = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.5, 0.3, 0.3, 0.5])], "s string, i int, v double")
    assert low.where("false").union(low.withColumn("m", signals.local_minimum("v", "s", "i")).where("m").drop("m")).count() == 0
    peak = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 3, 1])], "s string, i int, v int")
    assert [r["i"] for r in peak.withColumn("m", signals.local_peak("v", "s", "i")).where("m").orderBy("i").collect()] == [0, 1]


def test_keyed_replace_and_report(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3)], "k string, v int")
    assert {tuple(r) for r in sinks.replace_keyed(old, new, "k").collect()} == {("a", 1), ("b", 3)}
    page = sinks.html_table(new, "v")
    assert '<td class="best">3</td>' in page and "<td>b</td>" in page


def test_optional_files_and_sinks(spark, tmp_path):
    import json

    assert transcripts.read_slides(spark, f"file://{tmp_path}/none_slides.txt").count() == 0
    assert transcripts.read_boundaries(spark, f"file://{tmp_path}/none.txt", strip_prefix=True, optional=True).count() == 0
    df = spark.createDataFrame([("\u00e9", 1), (None, 2)], "k string, v int")
    text = sinks.pretty_json(df)
    assert json.loads(text) == [{"k": "\u00e9", "v": 1}, {"k": None, "v": 2}] and "\u00e9" in text and '\n    "v": 1' in text
    assert sinks.pretty_json(df.where("false")) == "[]"
    assert spark.range(1).select(sinks.preview(F.array(*map(F.lit, range(10)))).alias("p")).first()["p"] == "0, 1, 2, 3, 4, 5, 6, 7 (+2 more)"
    assert sinks.html_table(spark.range(1500)).count("<tr>") == 1501
    page = sinks.html_report("A & B", {"one": (df, "v"), "two": (df, None)})
    assert "A &amp; B" in page and page.count("<h2>") == 2 and page.count('class="best"') == 1
    odd = spark.createDataFrame([("x", "0.5"), ("y", "n/a"), ("z", " 0.5"), ("w", None), ("v", "nan")], "k string, v string")
    assert sinks.html_table(odd, "v").count('class="best"') == 2 and sinks.html_table(odd, "v", whole_row=True).count('<tr class="best"><td>x') == 1
    assert "No data" in sinks.html_table(odd.where("false"), "v")
    with pytest.raises(ValueError, match="up to 3 rows"):
        sinks.html_table(odd, most=3)


def test_display_formats(spark):
    x = spark.createDataFrame([(59.999, "E1", 0.5)], "s double, e string, d double")
    r = x.select(X.minutes_centis(F.col("s")).alias("a"), X.hms_centis(F.col("s") + 3600).alias("b"), X.signed(F.col("d")).alias("c"), X.named(F.col("e"), {"E1": "Semantic"}).alias("d"), X.tick(F.col("d") > 1).alias("e"), X.millis_centis(F.lit(61_990)).alias("f")).first()
    assert tuple(r) == ("01:00.00", "01:01:00.00", "+0.5000", "Semantic", "\u00d7", "01:01.99")
    frames = spark.createDataFrame([("a", i * 100, -60.0 if 20 <= i < 40 else 0.0) for i in range(100)], "seq_id string, ms long, energy double")
    assert sorted(r["ms"] for r in transcripts.silence_marks(frames).collect()) == [0, 2950]
