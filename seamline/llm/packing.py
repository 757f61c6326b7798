"""Packing of documents into fixed-length token sequences by best-fit decreasing.

Nulls: a null text is an empty text, which has the end id alone; a null doc_id stays null. Repeated rows are packed as
often as they occur; ties of length go by doc_id, then start. An empty table gives an empty result. Further columns
of the input are not read, so names that clash with the result's do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokenizing import MOST, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Texts that a Python worker holds at once.
TEXTS_AT_ONCE = 512


class OpenWindows:
    """The open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, left: int, window: int) -> None:
        self.stacks[left].append(window)
        node = left + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least remaining capacity that holds ``need``; it is no longer open."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        left = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return left, self.stacks[left].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length, taken in the given (descending) order."""
    windows, at, offsets, n = OpenWindows(capacity), [], [], 0
    for length in lengths:
        if found := windows.take(length):
            left, window = found
        else:
            left, window, n = capacity, n, n + 1
        at.append(window)
        offsets.append(capacity - left)
        if left > length:
            windows.put(left - length, window)
    return at, offsets


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, chunks: int = MOST) -> DataFrame:
    """The pieces of each document: full windows, then the rest of under a window. chunks: see pack()."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer, False, 4, chunks), np.array([end_id], "<u4").tobytes()
        for frame in frames:
            rows = []
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                for doc, ids in zip(part["doc_id"].tolist(), enc.encode_all(part["text"].tolist())):
                    ids += end
                    total = len(ids) // 4
                    doc = None if doc is None or doc != doc else int(doc)
                    for start in range(0, total, capacity):
                        part_ids = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc, start, len(part_ids) // 4, zlib.crc32(part_ids), total))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_docs: int = 16_384, chunks: int = MOST) -> DataFrame:
    """Pack all documents into windows of ``capacity`` ids: one row per piece, PACKED.

    Pieces are dealt by the places of their rows, whatever these hold, to groups of about ``group_docs`` pieces (a piece
    being some 4,000 characters at least, or a document), so a group's size does not grow with the table, with long
    documents or with repeated rows, and each group packs its own windows; what that costs is part of one window per
    group. A sequence's id has its group in the upper half. chunks: chunks of text whose ids a Python worker keeps; with
    fewer it holds less memory and encodes more anew.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.floor(F.length("text") / 4000)).alias("more")).first()
    groups = max(1, -(-(size["n"] + (size["more"] or 0)) // group_docs))

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        windows, offsets = best_fit(frame["length"].tolist(), capacity)
        return frame.drop(columns="pack_group").assign(sequence_id=np.array(windows, "int64") + (int(key[0]) << 32), offset=offsets)

    pieces = written(cut(docs, tokenizer, end_id, capacity, chunks), "pieces", batch=TEXTS_AT_ONCE)
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(packed, PACKED)
