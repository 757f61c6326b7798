"""Streaming operators give what their batch forms give, once the watermark has passed."""

import pytest
from pyspark.sql import functions as F

from seamline.streaming import live

BASE = 1_700_000_000


def stream(spark, tmp_path, name, rows, schema):
    """Rows as a stream of one file each batch, with a last row of another sequence that moves the watermark on."""
    folder = f"{tmp_path}/{name}"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + BASE)).drop("s")
    df.coalesce(1).write.mode("append").parquet(folder)
    late = spark.createDataFrame([("end", 10_000_000.0) + tuple(None for _ in rows[0][2:])], schema).withColumn("ts", F.timestamp_seconds(F.col("s") + BASE)).drop("s")
    late.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").outputMode("append").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).where("user_id != 'end'").collect()


ROWS = [("a", float(t), v) for t, v in [(0, 0.5), (10, 0.3), (35, 0.9), (36, 0.1)]]
SCHEMA = "user_id string, s double, value double"


def test_tumbling_and_sessions(spark, tmp_path):
    events = stream(spark, tmp_path, "e1", [(u, s, "x") for u, s, _ in ROWS], "user_id string, s double, text string")
    assert sorted(r["n"] for r in drain(live.tumbling(events, "20 seconds", "1 second"), tmp_path, "w1")) == [2, 2]
    assert sorted(r["n"] for r in drain(live.sessions(events, "25 seconds", "1 second"), tmp_path, "w2")) == [4]


@pytest.mark.parametrize(("strength", "expected"), [(None, [0, 35]), ("value", [10, 36])])
def test_spaced(spark, tmp_path, strength, expected):
    events = stream(spark, tmp_path, "e2", ROWS, SCHEMA)
    got = drain(live.spaced(events, 20.0, "1 second", strength=strength), tmp_path, f"s_{strength}")
    assert sorted(int(r["ts"].timestamp()) - BASE for r in got) == expected


def test_gated(spark, tmp_path):
    dips = stream(spark, tmp_path, "e3", ROWS, SCHEMA)
    marks = stream(spark, tmp_path, "e4", [("a", 12.0, 0.0), ("b", 35.0, 0.0)], SCHEMA)
    got = drain(live.gated(dips, marks, 5, "1 second"), tmp_path, "g")
    assert sorted(int(r["ts"].timestamp()) - BASE for r in got) == [10]
