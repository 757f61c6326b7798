"""Language-model scores by stupid backoff, from n-gram counts over the whole corpus.

Documents are dealt to blocks by a hash. Each block explodes its texts' n-grams of every order, folds equal ones, and
sends each hash range's share, with its counts, to that range's partition: the count tables, partitioned by hash. A
partition sums the counts of its n-grams over all blocks and joins the sums back to the n-grams each block asked for.
The block then sums its documents' scores. An n-gram travels once per block that has it, however common it is, so no
partition holds more than (its share of the n-grams) x (blocks that have them).

A word's score is c(n-gram) / c(context) at the longest order at which the n-gram occurs in another document, times
``backoff`` for each order above it that had none; a word that no other document has scores 1 / (all words). A
document's own occurrences are left out of all counts, or every n-gram would have been seen. Words are lower-case runs
of letters and digits. N-grams are compared by hashes of 20 bits more than it takes to number the corpus's characters
(48 to 64), so an n-gram is mistaken for another with a probability of under one in a million.

Nulls: a null or empty text has no words, n_tokens 0 and null scores. A null doc_id is scored like any other. Repeated
rows are documents of their own, each evidence for the other. An empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, words_of

SCORED = "doc_id long, n_tokens long, log10_sum double, log10_mean double"
ORDER, BACKOFF = 3, 0.4
#: Characters of text in a block; n-grams in a hash partition.
BLOCK_CHARS, PART_NGRAMS = 9_000_000, 2_000_000
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _planes(x: np.ndarray) -> bytes:
    """The values' bytes, those of equal rank together, compressed: high ones are mostly zero and cost next to nothing."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


class Block:
    """A block's n-grams: ``hashes``, sorted, each once; ``at[k]``: for order k + 1 the place in there of the n-gram
    that starts at each word, with -1 where it would leave the text. The empty n-gram, hash 0, stands for all words."""

    def __init__(self, words: list[np.ndarray], order: int, bits: int = 64):
        self.bits = bits
        self.lengths = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words).astype(np.int64).view(np.uint64) if len(words) else np.zeros(0, np.uint64)
        self.n = len(flat)
        self.ends = np.cumsum(self.lengths)
        self.doc = np.repeat(np.arange(len(words)), self.lengths)
        left = self.ends[self.doc] - np.arange(self.n)  # words from here to the text's end
        every, fits, h = [np.zeros(1, np.uint64)], [], np.zeros(self.n, np.uint64)
        for k in range(order):
            h = h[: max(0, self.n - k)] * _TIMES + flat[k:]
            h = _mix(h + np.uint64(k + 1))
            fits.append(np.flatnonzero(left[: len(h)] > k))
            every.append(np.maximum(h[fits[-1]] >> np.uint64(64 - bits), np.uint64(1)))
        self.hashes, inverse, self.counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
        self.counts[0] = self.n if self.n else 0
        self.at, start = [], 1
        for where in fits:
            places = np.full(self.n, -1, np.int64)
            places[where] = inverse[start : start + len(where)]
            self.at.append(places)
            start += len(where)

    def bounds(self, parts: int) -> np.ndarray:
        """Where each hash partition's share of ``hashes`` begins, and the end."""
        edges = np.array([(p << self.bits) // parts for p in range(1, parts)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.hashes, edges), [len(self.hashes)]])

    def scores(self, totals: np.ndarray, backoff: float) -> np.ndarray:
        """Each document's sum of log10 scores, given the corpus's count of each n-gram."""
        if not self.n:
            return np.zeros(len(self.lengths))
        others = []
        for places in self.at:
            there = np.flatnonzero(places >= 0)
            _, inverse, own = np.unique(self.doc[there] * np.int64(len(self.hashes)) + places[there], return_inverse=True, return_counts=True)
            left = np.zeros(self.n, np.int64)
            left[there] = totals[places[there]] - own[inverse]
            others.append(left)
        order = len(others)
        first = self.ends[self.doc] - self.lengths[self.doc]
        place = np.arange(self.n)
        longest = np.minimum(place - first + 1, order)  # n-gram that the text's beginning allows
        score, open_ = np.zeros(self.n), np.ones(self.n, bool)
        for k in range(order, 0, -1):
            start = place - (k - 1)
            can = open_ & (longest >= k)
            where = np.flatnonzero(can)
            seen = others[k - 1][start[where]]
            base = others[k - 2][start[where]] if k > 1 else totals[0] - self.lengths[self.doc[where]]
            hit = seen > 0
            got = where[hit]
            score[got] = np.log10(seen[hit] / base[hit]) + np.log10(backoff) * (longest[got] - k)
            open_[got] = False
        rest = np.flatnonzero(open_)
        score[rest] = -np.log10(totals[0]) + np.log10(backoff) * (longest[rest] - 1)
        return np.bincount(self.doc, score, len(self.lengths))


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """SCORED for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    parts = max(1, -(-chars * order // (6 * PART_NGRAMS)))
    bits = min(64, max(48, int(chars).bit_length() + 20))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    held = dealt.repartition(partitions(spark), "block").select("block", "doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))

    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block = Block(list(frame["words"]), order, bits)
        cuts = block.bounds(parts)
        shares = [(block.hashes[a:b], block.counts[a:b].astype("<u4")) for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame({"part": np.arange(parts), "block": int(key[0]), "hashes": [_planes(np.diff(h, prepend=np.uint64(0))) for h, _ in shares], "counts": [_planes(c) for _, c in shares]})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(_unplanes(x, "<u8")) for x in frame["hashes"]]
        counts = np.concatenate([_unplanes(x, "<u4") for x in frame["counts"]])
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(inverse, counts)[inverse].astype("<u8")
        ends = np.cumsum([len(h) for h in hashes])
        return pd.DataFrame({"block": frame["block"], "part": int(key[0]), "sums": [_planes(s) for s in np.split(sums, ends[:-1])]})

    def finish(key: tuple, docs: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        block = Block(list(docs["words"]), order, bits)
        totals = np.concatenate([_unplanes(x, "<u8") for x in sums.sort_values("part")["sums"]]).astype(np.int64)
        found, n = block.scores(totals, backoff), block.lengths
        none = np.where(n > 0, 1.0, np.nan)
        return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "n_tokens": n, "log10_sum": found * none, "log10_mean": found * none / np.maximum(n, 1)})

    asked = held.groupBy("block").applyInPandas(ask, "part long, block long, hashes binary, counts binary")
    answered = asked.groupBy("part").applyInPandas(add, "block long, part long, sums binary")
    done = held.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(finish, SCORED)
    return done.select("doc_id", "n_tokens", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("log10_sum", "log10_mean")))
