"""Token-id files with keyed access: shards of raw ids, and a minimal perfect hash index from document key to place.

A store is a folder with two Parquet data sets, so that any store that Spark writes to will do, and a lost executor's
part is written again under Spark's commit protocol:

``payload``, a folder per part: one row per segment (``segment``, ``doc_ids``, ``counts``, ``ids``). ``ids`` holds the raw
little-endian ids of the segment's documents one after another, of ``width`` bytes each; ``counts`` their numbers of
ids. Segments in ascending order hold the documents in ascending order of doc_id (null first, ties by the text's hash).

``index``, a folder per shelf of buckets: one row per bucket of keys: the bit arrays of a minimal perfect hash, and at each key's slot a 16-bit
fingerprint, the key's segment and position, and how many rows have that key. A key's hash names its shelf and bucket,
and a segment's number its part, so a few keys are read from as many files.

Nulls: a null text is empty (the end id alone). A null doc_id is stored first and has no key. Repeated doc_ids are all
stored; their key leads to the first and says how many follow. An empty table gives a store without rows. Further
columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions
from .tokenizing import encoder

PAYLOAD = "segment long, width int, doc_ids array<long>, counts array<int>, ids binary, part int"
INDEX = "bucket long, n int, sizes array<int>, bits binary, fingerprints binary, segments binary, positions binary, repeats binary, shelf long"
FOUND = "doc_id long, segment long, position int, repeats int"
_BUCKET_KEYS, _SHELF_BUCKETS = 8192, 32
#: So many folders and rows of them are named in a filter, which opens only these; more are joined.
_NAMED = 1000


# ---- minimal perfect hash

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix of each key, different for each seed."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mph_build(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits for distinct keys: at each level the keys that are alone at their bit stay there."""
    sizes, bits, left, level = [], [], keys, 0
    while len(left):
        size = max(8, int(1.5 * len(left)))
        at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left, level = left[~alone[at]], level + 1
        if level > 200:
            raise ValueError("keys are not distinct")
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def mph_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key, from 0 to the number of keys less one; -1 for a key that no level has (it is not in the set)."""
    slots, rank, base = np.full(len(keys), -1, np.int64), np.cumsum(bits) - 1, 0
    open_ = np.arange(len(keys))
    for level, size in enumerate(sizes):
        at = base + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        slots[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return slots


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1_000_003) >> np.uint64(48)).astype("<u2")


# ---- writing

def _segments(tokenizer: str, drops_space: bool, end_id: int, width: int, most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, seq, part = encoder(tokenizer, drops_space, width), np.array([end_id], f"<u{width}").tobytes(), 0, 0
        docs: list = []
        ids: list[bytes] = []
        held = 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"segment": [(part << 32) + seq], "width": [width], "doc_ids": [docs], "counts": [[len(x) // width for x in ids]], "ids": [b"".join(ids)], "part": [part]})

        for frame in frames:
            for at in range(0, len(frame), 256):
                piece = frame.iloc[at : at + 256]
                part = int(piece["part"].iloc[0])
                for doc, x in zip(piece["doc_id"].tolist(), enc.encode_all(piece["text"].tolist())):
                    docs.append(None if doc is None or doc != doc else int(doc))
                    ids.append(x + end)
                    held += len(x) + width
                    if held >= most:
                        yield row()
                        docs, ids, held, seq = [], [], 0, seq + 1
        if docs:
            yield row()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 4, drops_space: bool = False, segment_bytes: int = 2 << 20) -> None:
    """Encode all documents and write payload and index. drops_space: the tokenizer drops white space."""
    spark = docs.sparkSession
    ranged = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(partitions(spark), "doc_id", "tie", "row")  # equal rows may lie in several ranges
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    payload = ranged.mapInPandas(_segments(tokenizer, drops_space, end_id, width, segment_bytes), PAYLOAD)
    payload.write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/payload")
    _index(spark, path).write.option("compression", "zstd").partitionBy("shelf").parquet(f"{path}/index")


def _payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).parquet(f"{path}/payload")


def _buckets(spark: SparkSession, path: str) -> int:
    rows = _payload(spark, path).agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    return max(1, -(-rows // _BUCKET_KEYS))


def _index(spark: SparkSession, path: str) -> DataFrame:
    buckets = _buckets(spark, path)
    keys = _payload(spark, path).select("segment", F.posexplode("doc_ids").alias("position", "doc_id")).where("doc_id is not null")
    first = keys.groupBy("doc_id").agg(F.min(F.struct("segment", "position")).alias("at"), F.count("*").cast("int").alias("repeats"))
    flat = first.select("doc_id", "at.segment", "at.position", "repeats", _bucket(buckets)).withColumn("shelf", F.expr(f"bucket div {_SHELF_BUCKETS}"))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["doc_id"].to_numpy("int64")
        sizes, bits = mph_build(ids)
        order = np.argsort(mph_slots(ids, sizes, bits))
        frame, ids = frame.iloc[order], ids[order]
        return pd.DataFrame({"bucket": [int(key[1])], "n": [len(ids)], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()], "fingerprints": [fingerprint(ids).tobytes()], "segments": [frame["segment"].to_numpy("<i8").tobytes()], "positions": [frame["position"].to_numpy("<i4").tobytes()], "repeats": [frame["repeats"].to_numpy("<i4").tobytes()], "shelf": [int(key[0])]})

    shelved = flat.repartition(partitions(spark), "shelf") if buckets > _SHELF_BUCKETS else flat
    return shelved.groupBy("shelf", "bucket").applyInPandas(build, INDEX)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")


def _only(df: DataFrame, folder: str, row: str, wanted: DataFrame) -> DataFrame:
    """The rows of df that wanted (folder, row) names. Up to _NAMED are named in a filter, so that Spark opens their
    folders alone and skips other rows by their statistics."""
    named = wanted.select(folder, row).distinct().limit(_NAMED + 1).collect()
    if len(named) > _NAMED:
        return df.join(wanted.select(row).distinct(), row, "left_semi")
    return df.where(F.col(folder).isin(sorted({r[folder] for r in named})) & F.col(row).isin(sorted({r[row] for r in named}))) if named else df.where("false")


# ---- reading

def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """FOUND for each distinct key (column doc_id) that the index has. Each is found by its bucket's hash in constant
    time; a fingerprint turns away all but one in 65,536 of the keys that are absent, and read_documents() the rest."""
    buckets = _buckets(spark, path)
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    asked = keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().select("doc_id", _bucket(buckets)).withColumn("shelf", F.expr(f"bucket div {_SHELF_BUCKETS}"))
    index = _only(index, "shelf", "bucket", asked)

    def find(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(index):
            return pd.DataFrame({"doc_id": [], "segment": [], "position": [], "repeats": []}).astype({"doc_id": "int64", "segment": "int64", "position": "int32", "repeats": "int32"})
        ids, x = asked["doc_id"].to_numpy("int64"), index.iloc[0]
        sizes = [int(s) for s in x["sizes"]]
        slots = mph_slots(ids, sizes, np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: sum(sizes)].astype(bool))
        known = slots >= 0
        known[known] = np.frombuffer(x["fingerprints"], "<u2")[slots[known]] == fingerprint(ids[known])
        slots = slots[known]
        return pd.DataFrame({"doc_id": ids[known], "segment": np.frombuffer(x["segments"], "<i8")[slots], "position": np.frombuffer(x["positions"], "<i4")[slots], "repeats": np.frombuffer(x["repeats"], "<i4")[slots]})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, FOUND)


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """Rows and ids before each segment: sums over the segments of a part, on sums over parts."""
    sums = _payload(spark, path).select("part", "segment", F.size("counts").alias("rows"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    parts = sums.groupBy("part").agg(F.sum("rows").alias("part_rows"), F.sum("tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part: as many as shuffle partitions
    parts = parts.select("part", *(F.coalesce(F.sum(f"part_{k}").over(before), F.lit(0)).alias(f"part_{k}") for k in ("rows", "tokens")))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.select("part", "segment", *(F.coalesce(F.sum(k).over(within), F.lit(0)).alias(f"in_{k}") for k in ("rows", "tokens")))
    return inner.join(parts, "part").select("segment", *((F.col(f"part_{k}") + F.col(f"in_{k}")).alias(f"{k}_before") for k in ("rows", "tokens")))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document, read back from the payload: row number, doc_id, start, n_tokens, ids_crc32."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for segment, width, docs, counts, ids in zip(*(frame[k] for k in ("segment", "width", "doc_ids", "counts", "ids"))):
                counts = np.asarray(counts, "int64")
                ends = np.cumsum(counts)
                wide = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                crc = [zlib.crc32(wide[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
                doc_id = pd.array([None if d is None or d != d else int(d) for d in docs], "Int64")
                yield pd.DataFrame({"segment": int(segment), "position": np.arange(len(counts), dtype="int32"), "doc_id": doc_id, "start": ends - counts, "n_tokens": counts, "ids_crc32": crc})

    rows = _payload(spark, path).select("segment", "width", "doc_ids", "counts", "ids").mapInPandas(run, "segment long, position int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(_bases(spark, path), "segment").select((F.col("rows_before") + F.col("position")).alias("row"), "doc_id", (F.col("tokens_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "segment", "position")


def segments_of(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The payload's rows that hold the documents of places (FOUND)."""
    found = places.select("segment").distinct()
    if not (several := places.where("repeats > 1").select("doc_id")).isEmpty():  # may go on in later segments
        stored = _payload(spark, path).select("segment", F.explode("doc_ids").alias("doc_id"))
        found = found.union(stored.join(several, "doc_id", "left_semi").select("segment")).distinct()
    return _only(_payload(spark, path), "part", "segment", found.select("segment", F.shiftright("segment", 32).cast("int").alias("part")))


def read_documents(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The ids of the documents with these keys: doc_id, segment, position, ids (array<long>). Only the segments that
    the index names are opened; the stored doc_id is compared, so an absent key gives nothing."""
    hit = segments_of(spark, path, lookup(spark, path, keys))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for segment, width, docs, counts, ids in zip(*(frame[k] for k in ("segment", "width", "doc_ids", "counts", "ids"))):
                ends = np.cumsum(np.asarray(counts, "int64"))
                flat = np.frombuffer(ids, f"<u{width}").astype("int64")
                doc_id = pd.array([None if d is None or d != d else int(d) for d in docs], "Int64")
                yield pd.DataFrame({"doc_id": doc_id, "segment": int(segment), "position": np.arange(len(ends), dtype="int32"), "ids": np.split(flat, ends[:-1])})

    rows = hit.select("segment", "width", "doc_ids", "counts", "ids").mapInPandas(run, "doc_id long, segment long, position int, ids array<long>")
    wanted = keys.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct()
    return rows.join(wanted, rows["doc_id"] == wanted["key"], "left_semi")


def indexed_digests(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """digests() of every key, each reached through the index; rows without a key (null doc_id) come as they are stored."""
    rows = digests(spark, path)
    first = lookup(spark, path, keys).join(_bases(spark, path), "segment").select(F.explode(F.sequence(F.col("rows_before") + F.col("position"), F.col("rows_before") + F.col("position") + F.col("repeats") - 1)).alias("row"), F.col("doc_id").alias("key"))
    joined = rows.join(first, "row", "left")
    return joined.where(F.col("doc_id").isNull() | (F.col("key") == F.col("doc_id"))).select("doc_id", "start", "n_tokens", "ids_crc32", "segment", "position")
