"""Readers of caption files, annotations, event times and reports. Paths may be globs in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, clock_seconds, file_stem

CUES = "lecture_id string, block_id int, start double, end double, text string"
_ARROW = "-->"


def bodies(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """lecture_id (the file's name without suffix and extension), body: whole files with ends of lines made one kind."""
    return _named(spark.read.text(path, wholetext=True), suffix)


def stream_bodies(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """The same as a stream of the files that come to a folder or glob."""
    return _named(spark.readStream.text(path, wholetext=True), suffix)


def _named(raw: DataFrame, suffix: str) -> DataFrame:
    return raw.select(file_stem(F.col("_metadata.file_path"), suffix).alias("lecture_id"), F.regexp_replace("value", "\r\n?", "\n").alias("body"))


def cues_of(files: DataFrame, cleaning: str = "tags", drop_empty: bool = False, skip_notes: bool = True, strict: bool = False) -> DataFrame:
    """CUES of WebVTT bodies (lecture_id, body), a table or a stream: one row per cue in file order.

    cleaning: strict (tags and [labels] go), tags, or none (the raw variant). drop_empty leaves out cues whose cleaned
    text is empty. An id line before the times is passed over; text ends at a blank line. A time that is no clock is
    null, or with strict stops the job. A body is taken apart where it lies; nothing is shuffled.
    """
    blocks = F.split("body", r"\n[ \t]*\n")
    if skip_notes:
        blocks = F.filter(blocks, lambda b: ~F.rlike(F.trim(b), F.lit(r"^NOTE\b[^\n]*$")))
    lines = F.filter(F.transform(blocks, lambda b: F.transform(F.split(b, "\n"), lambda x: F.trim(x))), lambda b: F.exists(b, lambda x: F.contains(x, F.lit(_ARROW))))

    def cue(b: Column) -> Column:
        at = F.array_position(F.transform(b, lambda x: F.contains(x, F.lit(_ARROW))), True).cast("int")
        text = F.array_join(F.filter(F.slice(b, at + 1, F.size(b)), lambda x: x != ""), " ")
        return F.struct(F.element_at(b, at).alias("times"), clean(text, cleaning).alias("text"))

    cues = F.transform(lines, cue)
    if drop_empty:
        cues = F.filter(cues, lambda c: c["text"] != "")
    rows = files.select("lecture_id", F.posexplode(cues).alias("block_id", "_c"))
    clock = lambda pattern: clock_seconds(F.regexp_extract("_c.times", pattern, 1), strict)
    return rows.select("lecture_id", "block_id", clock(r"(\S+)\s*-->").alias("start"), clock(r"-->\s*(\S+)").alias("end"), F.col("_c.text").alias("text"))


def read_cues(spark: SparkSession, path: str, cleaning: str = "tags", drop_empty: bool = False, skip_notes: bool = True, strict: bool = False) -> DataFrame:
    """CUES of WebVTT files, as cues_of() takes them apart."""
    return cues_of(bodies(spark, path), cleaning, drop_empty, skip_notes, strict)


def lines_of(files: DataFrame) -> DataFrame:
    """lecture_id, line, value: the trimmed lines of bodies."""
    return files.select("lecture_id", F.posexplode(F.split("body", "\n")).alias("line", "value")).withColumn("value", F.trim("value"))


def _lines(spark: SparkSession, path: str, suffix: str, optional: bool = False) -> DataFrame:
    if optional and not exists(spark, path):
        return spark.createDataFrame([], "lecture_id string, line int, value string")
    return lines_of(bodies(spark, path, suffix))


def _numbered(rows: DataFrame, name: str, *order: str) -> Column:
    return (F.row_number().over(Window.partitionBy("lecture_id").orderBy(*order)) - 1).cast("int").alias(name)


def read_boundaries(spark: SparkSession, path: str, suffix: str = "_boundaries", lenient: bool = False, strip_prefix: bool = False, optional: bool = False) -> DataFrame:
    """lecture_id, gt_index, time, time_str, title of annotation files (``HH:MM:SS title``); other lines are dropped.

    File order is kept; lenient takes one-digit hours, needs a title and sorts by time; strip_prefix takes a leading
    ``L<n>:`` off titles and sorts too. With optional, files that do not exist give an empty table.
    """
    return boundaries_of(_lines(spark, path, suffix, optional), lenient, strip_prefix)


def boundaries_of(lines: DataFrame, lenient: bool = False, strip_prefix: bool = False) -> DataFrame:
    """read_boundaries' rows of lines (lines_of())."""
    pattern = r"^(\d{1,2}:\d{2}:\d{2})\s+(.+)$" if lenient else r"^(\d{2}:\d{2}:\d{2})\s+(.*)$"
    rows = lines.withColumn("time_str", F.regexp_extract("value", pattern, 1)).where("time_str != ''")
    title = F.trim(F.regexp_extract("value", pattern, 2))
    if strip_prefix:
        title = F.regexp_replace(title, r"^L\d+:\s*", "")
    rows = rows.select("lecture_id", "line", clock_seconds(F.col("time_str")).alias("time"), "time_str", title.alias("title"))
    return rows.select("lecture_id", _numbered(rows, "gt_index", *(("time", "line") if lenient or strip_prefix else ("line",))), "time", "time_str", "title")


def read_fine_boundaries(spark: SparkSession, path: str, suffix: str = "_boundaries") -> DataFrame:
    """Fine annotations with their tab-separated parts: seg_id, label, section, topic beside read_boundaries' columns."""
    return fine_parts(read_boundaries(spark, path, suffix))


def fine_parts(rows: DataFrame) -> DataFrame:
    """Boundaries with the tab-separated parts of their titles."""
    part = F.split("title", "\t")
    topic = F.regexp_extract(F.get(part, F.lit(2)), r"^(.*?) : (.*)$", 2)
    section = F.regexp_extract(F.get(part, F.lit(2)), r"^(.*?) : (.*)$", 1)
    return rows.select("*", F.get(part, F.lit(0)).alias("seg_id"), F.get(part, F.lit(1)).alias("label"), section.alias("section"), topic.alias("topic"))


def read_silences(spark: SparkSession, path: str, suffix: str = "_pred") -> DataFrame:
    """lecture_id, time of MM:SS.cc lines, sorted by whoever reads them; digits after the second of the fraction are cut."""
    return silences_of(_lines(spark, path, suffix))


def silences_of(lines: DataFrame) -> DataFrame:
    pattern = r"^(\d+):(\d{2})\.(\d{2,})"
    rows = lines.where(F.rlike("value", F.lit(pattern)))
    get = lambda k: F.regexp_extract("value", pattern, k)
    return rows.select("lecture_id", (get(1).cast("double") * 60 + get(2).cast("double") + F.substring(get(3), 1, 2).cast("double") / 100).alias("time"))


def read_slides(spark: SparkSession, path: str, suffix: str = "_slides") -> DataFrame:
    """lecture_id, time of slide changes: a leading HH:MM:SS; blank and # lines are skipped. Files that do not exist give
    an empty table."""
    return slides_of(_lines(spark, path, suffix, True))


def slides_of(lines: DataFrame) -> DataFrame:
    found = F.regexp_extract("value", r"^(\d{1,2}:\d{2}:\d{2})", 1)
    return lines.select("lecture_id", clock_seconds(F.when(found != "", found)).alias("time")).where("time is not null")


def scene_times(log: DataFrame) -> DataFrame:
    """lecture_id, time: distinct pts_time values of scene-detection logs (lecture_id, value)."""
    found = F.transform(F.regexp_extract_all("value", F.lit(r"pts_time:(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    return log.select("lecture_id", F.explode(found).alias("time")).distinct()


MATCH = "struct<gt_index:int,gt_time:double,gt_time_str:string,gt_title:string,pred_index:int,pred_time:double,pred_similarity:double,abs_error_sec:double>"
BOUNDARY = "boundary_index int, between_windows array<int>, boundary_time double, similarity double, left_window_end double, right_window_start double, reason string, prominence double"
REPORT = f"tolerance_sec double, gt_count int, pred_count int, TP int, FP int, FN int, precision double, recall double, f1 double, matches array<{MATCH}>"


def read_json(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """Whole-file JSON documents with the file's path, found at any depth below path."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path).withColumn("file_path", F.col("_metadata.file_path"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Boundary files under .../setting/lectureN/, with setting and lecture taken from the path; copies elsewhere drop out."""
    rows = read_json(spark, path, BOUNDARY, "*_boundaries.json")
    folder = r"([^/]+)/(lecture[^/]*)/[^/]+$"
    return rows.withColumn("setting", F.regexp_extract("file_path", folder, 1)).withColumn("lecture_id", F.regexp_extract("file_path", folder, 2)).where("lecture_id != ''").drop("file_path")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at the path or glob."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def lectures_with(spark: SparkSession, lectures: list[str], *patterns: str, missing: str = "skip") -> list[str]:
    """The lectures for which every pattern (``{}`` stands for the lecture) names a file. Others are left out, or with
    missing="raise" are an error."""
    if missing not in ("skip", "raise"):
        raise ValueError(f"missing is skip or raise, not {missing!r}")
    lacks = {k: [p.format(k) for p in patterns if not exists(spark, p.format(k))] for k in lectures}
    if missing == "raise" and any(lacks.values()):
        raise FileNotFoundError("; ".join(f"{k}: {', '.join(v)}" for k, v in lacks.items() if v))
    return [k for k in lectures if not lacks[k]]


def read_csv(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """The first of the paths that exists, with a header; an empty table if none does."""
    for path in paths:
        if exists(spark, path):
            return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return spark.createDataFrame([], schema)


def silence_marks(frames: DataFrame, below: float = 16.0, least_ms: int = 1000) -> DataFrame:
    """seq_id, ms: the middles of quiet stretches, and a leading 0 for each sequence."""
    found = audio_frames_silence(frames, below, least_ms).select("seq_id", F.col("mid_ms").alias("ms"))
    return frames.select("seq_id", F.lit(0).cast("long").alias("ms")).distinct().union(found)


def audio_frames_silence(frames: DataFrame, below: float = 16.0, least_ms: int = 1000, ties: str = "energy") -> DataFrame:
    """seq_id, start_ms, end_ms, mid_ms of quiet stretches in a table of frames (seq_id, ms, energy in dB).

    A frame is quiet at ``below`` dB or more under its sequence's mean; stretches of at least ``least_ms`` count. Frames of
    one millisecond go in the order of the column ``ties``; a stretch ends where a frame is not quiet, so those that are
    alike may come in any order.
    """
    mean = frames.groupBy("seq_id").agg(F.avg("energy").alias("mean_energy"))
    rows = frames.join(mean, "seq_id").withColumn("quiet", F.coalesce(F.col("energy") <= F.col("mean_energy") - below, F.lit(False)))
    order = Window.partitionBy("seq_id").orderBy("ms", ties, "quiet").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.withColumn("island", F.count_if(~F.col("quiet")).over(order)).where("quiet").groupBy("seq_id", "island").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))
    return spans.where(F.col("end_ms") - F.col("start_ms") >= least_ms).select("seq_id", "start_ms", "end_ms", F.expr("(start_ms + end_ms) div 2").alias("mid_ms"))
