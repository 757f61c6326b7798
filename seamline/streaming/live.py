"""Streaming forms of the operators whose results do not need a whole sequence.

Each takes a streaming DataFrame with an event-time column and returns one; late rows beyond the watermark are dropped,
as Structured Streaming has it. Matching and folds over labelled segments need both sides closed: run the batch plan
over what foreach_closed() hands on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str, seq: str = "user_id", ts: str = "ts", start: str = "0 seconds") -> DataFrame:
    """seq, start, end, n, texts of event-time windows anchored at ``start`` past the epoch."""
    rows = events.withWatermark(ts, late).groupBy(seq, F.window(ts, width, width, start))
    return rows.agg(F.count("*").alias("n"), F.collect_list("text").alias("texts")).select(seq, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "texts")


def sessions(events: DataFrame, gap: str, late: str, seq: str = "user_id", ts: str = "ts") -> DataFrame:
    """seq, start, end, n of runs without a gap of more than ``gap``; equal gaps merge."""
    rows = events.withWatermark(ts, late).groupBy(seq, F.session_window(ts, gap))
    return rows.agg(F.count("*").alias("n")).select(seq, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def gated(dips: DataFrame, markers: DataFrame, distance_s: int, late: str, seq: str = "user_id", ts: str = "ts") -> DataFrame:
    """Dips with a marker within distance_s seconds: a stream-stream join whose state the time bounds keep small. A dip
    comes once for each such marker; dropDuplicatesWithinWatermark removes the repeats."""
    d = dips.withWatermark(ts, late).alias("d")
    m = markers.select(F.col(seq).alias("m_seq"), F.col(ts).alias("m_ts")).withWatermark("m_ts", late).alias("m")
    on = (F.col(f"d.{seq}") == F.col("m_seq")) & F.expr(f"m_ts BETWEEN d.{ts} - INTERVAL {distance_s} SECONDS AND d.{ts} + INTERVAL {distance_s} SECONDS")
    return d.join(m, on).select("d.*").dropDuplicatesWithinWatermark([seq, ts])


def spaced(events: DataFrame, distance_s: float, late: str, seq: str = "user_id", ts: str = "ts", strength: str | None = None) -> DataFrame:
    """seq, ts, value of kept events: at least distance_s after the last kept one. With ``strength``, a strictly lower
    value takes the last one's place, which is given out only once event time has passed it by distance_s.

    State per sequence: the last kept event and those that the watermark has not passed yet.
    """
    value = F.col(strength).cast("double") if strength else F.lit(0.0)
    key_type = dict(events.dtypes)[seq]
    micros = lambda t: F.unix_micros(F.col(t).cast("timestamp"))
    rows = events.withWatermark(ts, late).select(seq, ts, micros(ts).alias("us"), value.alias("value"))
    gap = int(distance_s * 1_000_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, low, has, pending = state.get if state.exists else (0, 0.0, False, [])
        kept = (at, low) if has else None  # the last kept event; with strength, not given out yet
        held = [(int(p[0]), p[1]) for p in pending]
        for frame in frames:
            held += list(zip(frame["us"].tolist(), frame["value"].tolist()))
        closed = state.getCurrentWatermarkMs() * 1000
        ready, held, out = sorted(p for p in held if p[0] <= closed), [p for p in held if p[0] > closed], []
        for us, v in ready:
            if kept is None or us - kept[0] >= gap:
                if strength is None:
                    out.append((us, v))
                elif kept is not None:
                    out.append(kept)
                kept = (us, v)
            elif strength is not None and v < kept[1]:
                kept = (us, v)
        if kept is not None and closed - kept[0] >= gap and not held:  # nothing can come that it would bear on
            if strength is not None:
                out.append(kept)
            kept = None
        if kept is None and not held:
            state.remove()
        else:
            state.update((*(kept or (0, 0.0)), kept is not None, [[float(us), v] for us, v in held]))
            due = min([us for us, _ in held] + ([kept[0] + gap] if kept else []))
            state.setTimeoutTimestamp(max(closed // 1000, due // 1000) + 1)
        if out:
            yield pd.DataFrame({seq: [key[0]] * len(out), "us": [o[0] for o in out], "value": [o[1] for o in out]})

    return rows.groupBy(seq).applyInPandasWithState(
        step, f"{seq} {key_type}, us long, value double", "at long, low double, has boolean, pending array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout
    ).select(seq, F.timestamp_micros("us").alias("ts"), "value")


def foreach_closed(events: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that runs a batch plan on each micro-batch (of closed sequences) and appends to a Parquet table."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
