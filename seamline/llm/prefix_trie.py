"""The prefix trie of conversations by preorder intervals: ranks, subtree ends and differences of prefix sums.

A conversation's turns are ordered by turn, null first; equal turns by the SHA-256 of role and text. A null role or text
is empty. A node is a distinct sequence of first turns, named by a polynomial hash of 127 bits of its turns' hashes
(among 10^12 nodes of a million turns two are taken for one with odds of about 10^-8). As such a hash of a sequence is
made of those of its parts, a conversation of any length is hashed in ranges that tasks share out.

Preorder. Only nodes with several children tell conversations apart, so a conversation's key is the list of its turns
just below such nodes, in order; with its length it puts conversations in the order of their turns' hashes. (Every entry
needs another conversation of that depth or more, so m turns in all make no key longer than about sqrt(2 m).) Of equal
conversations one stands for all. A node's interval runs from the first to the last conversation below it; nodes sorted
by the interval's start, then depth, are in preorder, and its subtree ends with the last node that starts within the
interval. Sums over subtrees are differences of prefix sums over this order. Ranks and prefix sums come from ranges of
about equal size: each task sums its own, and one total for each range is carried on.

Rows without a conv_id belong to no conversation. A repeated row is a turn of its own. An empty table has no node, not
even the root. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, partitions, written

#: Rows of a range at most, about: what one task sorts, and of which one total travels.
ROWS = 1_000_000
#: Bytes of ids that are hashed at once.
CHUNK = 1 << 20
#: Of the polynomial hash: the modulus, the base, and the hash of no turn.
_MODULUS, _BASE, _EMPTY = (1 << 127) - 1, 0x5DEECE66D1F3A7C59B7E151628AED2A7 >> 1, 1
ROOT = _EMPTY.to_bytes(16, "big")


# ---- ranges, ranks and prefix sums

def ranged(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df in a written table with part: the number of its range, which grows with the keys."""
    n = max(partitions(df.sparkSession), -(-df.count() // ROWS))
    return written(df.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()), name)


def running(df: DataFrame, keys: list[str], name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with at, each row's place (from 1) in the order of the keys, and sum_<column> up to and with it."""
    parts = ranged(df, keys, name)
    totals = parts.groupBy("part").agg(F.count("*").alias("at"), *[F.sum(c).alias(c) for c in sums]).orderBy("part").collect()
    before, rows = [0] * (1 + len(sums)), []
    for r in totals:
        rows.append((r["part"], *before))
        before = [b + x for b, x in zip(before, r[1:])]
    carried = df.sparkSession.createDataFrame(rows, "part int, _at long" + "".join(f", _{c} long" for c in sums))
    order = Window.partitionBy("part").orderBy(*keys)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # one row for each range
    return parts.join(F.broadcast(carried), "part").select(
        *df.columns, (F.row_number().over(order) + F.col("_at")).alias("at"), *[(F.sum(c).over(so_far) + F.col(f"_{c}")).alias(f"sum_{c}") for c in sums]
    )


# ---- rebuilt conversations

def turn_hash(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t (the turn's hash), n_chars, turns (how many the conversation has)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_hash(role, text).alias("t"), F.length(text).cast("long").alias("n_chars"))
    # equal rows may be taken in any order, so they may lie in several ranges
    placed = written(running(rows.withColumn("row", F.monotonically_increasing_id()), ["conv_id", "turn", "t", "row"], "turns").select("conv_id", "at", "t", "n_chars"), "places")
    starts = placed.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("turns"))
    return placed.join(starts, "conv_id").select("conv_id", (F.col("at") - F.col("start") + 1).alias("pos"), "t", "n_chars", "turns")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv_id, pos, t, n_chars, last), and their lengths (conv_id, length).

    Conversation c takes the first h turns of conversation c - c % group, then its own after its first h; h is
    crc32(c in decimal) % most. At most ``group`` conversations share a head, so no head is met by more.
    """
    turns = written(turns, "ordered")
    own = turns.groupBy("conv_id").agg(F.max("turns").alias("turns"))
    own = own.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % group).alias("head"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    heads = own.where("conv_id = head").select("head", F.col("turns").alias("head_turns"))
    own = own.join(heads, "head", "left").withColumn("given", F.least("h", F.coalesce("head_turns", F.lit(0))))
    own = written(own.select("conv_id", "head", "h", "given", (F.col("given") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    kept = turns.join(own, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "t", "n_chars", "length")
    first = turns.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("head"), "pos", "t", "n_chars")
    given = own.select("conv_id", "head", "h", "length").join(first, "head").where("pos <= h").select("conv_id", "pos", "t", "n_chars", "length")
    return kept.unionByName(given).select("conv_id", "pos", "t", "n_chars", (F.col("pos") == F.col("length")).alias("last")), own.select("conv_id", "length")


def hashed(rows: DataFrame) -> DataFrame:
    """rows with node and parent: the hashes of the turns up to each one, with it and without it."""
    parts = ranged(rows, ["conv_id", "pos"], "rebuilt")

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        """What a range adds to the conversation that it ends in."""
        frame = frame.sort_values(["conv_id", "pos"])
        conv = int(frame["conv_id"].iloc[-1])
        own = frame["t"][frame["conv_id"] == conv]
        value = 0
        for t in own:
            value = (value * _BASE + int.from_bytes(t, "big")) % _MODULUS
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "conv_id": [conv], "n": [len(own)], "whole": [len(own) == len(frame)], "value": [value.to_bytes(16, "big")]})

    ends = parts.groupBy("part").applyInPandas(summary, "part int, conv_id long, n long, whole boolean, value binary").orderBy("part").collect()
    at, carry = (None, _EMPTY), {}
    for r in ends:
        carry[r["part"]] = at
        before = at[1] if r["whole"] and at[0] == r["conv_id"] else _EMPTY
        at = (r["conv_id"], (before * pow(_BASE, r["n"], _MODULUS) + int.from_bytes(r["value"], "big")) % _MODULUS)
    shared = rows.sparkSession.sparkContext.broadcast(carry)  # one entry for each range

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["conv_id", "pos"])
        conv, value = shared.value[int(frame["part"].iloc[0])]
        nodes, parents = [], []
        for c, t in zip(frame["conv_id"].tolist(), frame["t"].tolist()):
            if c != conv:
                conv, value = c, _EMPTY
            parents.append(value.to_bytes(16, "big"))
            value = (value * _BASE + int.from_bytes(t, "big")) % _MODULUS
            nodes.append(value.to_bytes(16, "big"))
        return frame[["conv_id", "pos", "t", "n_chars", "last"]].assign(node=nodes, parent=parents)

    found = written(parts.groupBy("part").applyInPandas(run, "conv_id long, pos long, t binary, n_chars long, last boolean, node binary, parent binary"), "hashed")
    drop_path(rows.sparkSession, parts.written_path)
    return found


# ---- digests of ids

def id_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the decimal conv_ids of ends (conv_id, node) of each node, ascending, joined by commas.

    Each range of (node, conv_id) does the nodes that lie within it. A node that goes on in another range has its ids
    written out as text there; these texts, of CHUNK bytes at most, are hashed one after the other, as SHA-256 asks.
    """
    parts = ranged(ends.select("node", "conv_id"), ["node", "conv_id"], "members")

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["node", "conv_id"])
        out, part = [], int(frame["part"].iloc[0])
        runs = list(frame.groupby("node", sort=False)["conv_id"])
        for i, (node, ids) in enumerate(runs):
            text = ",".join(map(str, ids.tolist())).encode()
            if 0 < i < len(runs) - 1:
                out.append((node, part, 0, None, sha256(text).hexdigest()))
            else:
                out += [(node, part, at, text[at : at + CHUNK], None) for at in range(0, len(text), CHUNK)]
        return pd.DataFrame(out, columns=["node", "part", "at", "text", "digest"])

    found = written(parts.groupBy("part").applyInPandas(within, "node binary, part int, at long, text binary, digest string"), "digests")

    def chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, part, digest = None, None, None
        for frame in frames:
            done = []
            for n, p, text in zip(frame["node"], frame["part"], frame["text"]):
                if n != node:
                    if digest:
                        done.append((node, digest.hexdigest()))
                    node, part, digest = n, p, sha256()
                elif p != part:
                    part = p
                    digest.update(b",")
                digest.update(text)
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if digest:
            yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "ends_sha256"])

    pieces = found.where("text is not null").select("node", "part", "at", "text")
    pieces = pieces.repartition(partitions(ends.sparkSession), "node").sortWithinPartitions("node", "part", "at")
    long = written(pieces.mapInPandas(chained, "node binary, ends_sha256 string"), "chained", batch=64)
    return found.where("digest is not null").select("node", F.col("digest").alias("ends_sha256")).union(long)


# ---- the trie

def trie(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the conversations of rows (hashed()) and lengths: conv_id (the least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and at, subtree_end: places in preorder, from 1."""
    root = F.lit(bytearray(ROOT))
    ends = rows.where("last").select("conv_id", "node", F.col("pos").alias("depth"))
    ends = written(ends.union(lengths.where("length = 0").select("conv_id", root, F.lit(0).cast("long"))), "ends")
    one = written(ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.first("depth").alias("depth")).drop("node"), "one")
    paths = written(rows.join(one.select("conv_id", "copies"), "conv_id").select("conv_id", "copies", "pos", "t", "n_chars", "node", "parent"), "paths")

    forks = paths.groupBy("parent").agg(F.min("node").alias("n1"), F.max("node").alias("n2")).where("n1 != n2").select("parent")
    keys = paths.join(forks, "parent", "left_semi").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("key"))
    keyed = written(one.join(keys, "conv_id", "left").withColumn("key", F.coalesce("key", F.array().cast("array<binary>"))), "keys")
    ranks = written(running(keyed, ["key", "depth"], "ranks").select("conv_id", "copies", F.col("at").alias("rank")), "ranked")

    below = [F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.sum("copies").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    nodes = paths.drop("copies").join(ranks, "conv_id").groupBy("node").agg(*below, F.first("parent").alias("parent"), F.first("pos").alias("depth"), F.first("n_chars").alias("n_chars"))
    top = ranks.agg(*below).where("n_convs > 0").select(root.alias("node"), "*", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_chars"))
    nodes = written(nodes.unionByName(top), "nodes")

    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars"))
    placed = written(running(written(nodes, "leaves"), ["lo", "depth"], "preorder", ("leaf", "saved")), "placed")

    last = placed.groupBy(F.col("lo").alias("hi")).agg(F.max("at").alias("subtree_end"), F.max("sum_leaf").alias("end_leaf"), F.max("sum_saved").alias("end_saved"))
    parents = placed.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = placed.join(last, "hi").join(parents, "parent", "left").join(id_digests(ends), "node", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("end_leaf") - F.col("sum_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("sum_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        "at", "subtree_end",
    )


def conversation_trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations of conversations (conv_id, turn, role, text)."""
    rows, lengths = rebuilt(ordered_turns(conversations), group, most)
    return trie(hashed(rows), lengths)
