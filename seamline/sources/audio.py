"""Silence in audio: WAV files as a table of milliseconds, and quiet stretches by the energy of sliding windows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem, millis_centis

#: A stretch's least length in milliseconds, and decibels under the mean that count as quiet.
LEAST_MS, BELOW_DB = 1000, 16.0
FRAMES = "seq_id string, ms long, energy decimal(38,0), samples long"
#: Milliseconds decoded at once, and those of a window's range.
BLOCK_MS, RANGE_MS = 60_000, 600_000


def _header(data: memoryview) -> tuple[int, int, int, int, int]:
    """Channels, frames a second, bytes a sample, and where the samples begin and end, of a PCM WAV file."""
    if len(data) < 12 or bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if code == 0xFFFE and size >= 26:  # the extensible form names its code later
                code = struct.unpack_from("<H", data, at + 8 + 24)[0]
            if code != 1 or bits not in (8, 16, 32):
                raise ValueError("only PCM of 8, 16 or 32 bits is read")
            kind = channels, rate, bits // 8
        elif name == b"data":
            if kind is None:
                raise ValueError("samples before their format")
            return *kind, at + 8, min(at + 8 + size, len(data))
        at += 8 + size + size % 2
    raise ValueError("no samples")


def wav_energy(content: bytes) -> Iterator[pd.DataFrame]:
    """ms, energy (sum of squares of all channels' samples), samples of a WAV file, block by block. A last part of less
    than half a millisecond is left out, as rounding of the length does."""
    data = memoryview(content)
    channels, rate, width, begin, end = _header(data)
    frames = (end - begin) // (channels * width)
    length = round(1000 * frames / rate)
    kind = {1: "<u1", 2: "<i2", 4: "<i4"}[width]
    for at in range(0, length, BLOCK_MS):
        edges = np.minimum((np.arange(at, min(at + BLOCK_MS, length) + 1) * (rate / 1000.0)).astype(np.int64), frames)
        x = np.frombuffer(data[begin + int(edges[0]) * channels * width : begin + int(edges[-1]) * channels * width], kind)
        x = x.astype(np.int64) - (128 if width == 1 else 0)
        sums = np.concatenate([[0], np.cumsum(x.astype(object) ** 2 if width == 4 else x * x)])
        places = (edges - edges[0]) * channels
        yield pd.DataFrame({"ms": np.arange(at, at + len(edges) - 1), "energy": sums[places[1:]] - sums[places[:-1]], "samples": np.diff(places)})


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """FRAMES of WAV files: a row for each millisecond. A task holds one file at a time and decodes it in blocks."""
    from decimal import Decimal

    files = spark.read.format("binaryFile").load(path).select(file_stem(F.col("path"), "").alias("seq_id"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seq, content in zip(frame["seq_id"], frame["content"]):
                for block in wav_energy(content):
                    yield block.assign(seq_id=seq, energy=[Decimal(int(e)) for e in block["energy"]])[["seq_id", "ms", "energy", "samples"]]

    return files.mapInPandas(run, FRAMES)


def _rms(energy, samples):
    """Root of the mean square, as a whole number."""
    return F.floor(F.sqrt((energy / F.nullif(samples, F.lit(0).cast("long"))).cast("double")))


def quiet_stretches(frames: DataFrame, least_ms: int = LEAST_MS, below: float = BELOW_DB, span: int = RANGE_MS) -> DataFrame:
    """seq_id, start_ms, end_ms, mid_ms of the quiet stretches of frames (FRAMES).

    A window of ``least_ms`` is quiet if its root mean square is at least ``below`` dB under that of the whole; windows
    whose starts are at most least_ms apart make one stretch. Window sums are differences of running sums, taken in
    ranges of ``span`` milliseconds that see least_ms beyond their end, so a long recording is many tasks' work.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    whole = frames.groupBy("seq_id").agg(F.sum(exact("energy")).alias("_e"), F.sum("samples").alias("_s"), F.count("*").alias("_length"))
    loud = whole.select("seq_id", (_rms(F.col("_e"), F.col("_s")) * 10 ** (-below / 20)).alias("_limit"), "_length")
    own = F.floor(F.col("ms") / span)
    early = F.floor((F.col("ms") - least_ms + 1) / span)
    spread = frames.select("seq_id", "ms", "energy", "samples", F.explode(F.array_distinct(F.array(own, F.greatest(early, F.lit(0))))).alias("_b"))
    order = Window.partitionBy("seq_id", "_b").orderBy("ms")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = spread.select("seq_id", "_b", "ms", "energy", "samples", F.sum(exact("energy")).over(so_far).alias("_e"), F.sum("samples").over(so_far).alias("_s"))
    ahead = lambda c: F.lead(c, least_ms - 1).over(order)
    starts = summed.select("seq_id", "_b", "ms", (ahead("_e") - F.col("_e") + exact("energy")).alias("_e"), (ahead("_s") - F.col("_s") + F.col("samples")).alias("_s"))
    starts = starts.where((F.col("_b") == own) & F.col("_e").isNotNull()).join(loud, "seq_id").where(_rms(F.col("_e"), F.col("_s")) <= F.col("_limit"))
    w = Window.partitionBy("seq_id").orderBy("ms")
    new = F.coalesce(F.col("ms") - F.lag("ms").over(w) > least_ms, F.lit(True)).cast("int")
    runs = starts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("seq_id", "_run").agg(F.min("ms").alias("start_ms"), (F.max("ms") + least_ms).alias("end_ms"))
    return found.select("seq_id", "start_ms", "end_ms", F.expr("(start_ms + end_ms) div 2").alias("mid_ms"))


def silence_lines(frames: DataFrame, **how: float) -> DataFrame:
    """seq_id, ms, line: a leading 00:00.00 for each sequence, and the middles of its quiet stretches as MM:SS.cc."""
    marks = frames.select("seq_id", F.lit(0).cast("long").alias("ms")).distinct().union(quiet_stretches(frames, **how).select("seq_id", "mid_ms"))
    return marks.select("seq_id", "ms", millis_centis(F.col("ms")).alias("line"))
