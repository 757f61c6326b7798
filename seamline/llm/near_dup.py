"""Near-duplicate groups by order MinHash, verified by banded alignment.

A text's words are its lower-case runs of letters and digits. Each run of two words, labelled with how often it has
occurred before, is an element; a band takes the TAKEN elements with the least hash values under its own order, and its
key is their hashes in text order. Texts that are alike as sequences share band keys; texts that merely share many runs
in another order do not. Runs are of two words at every length: edits that lie evenly, one in every five words, leave a
text of whatever length no run of five, but three in five of its runs of two. A key holds four runs, so eight words and
their order, and few unlike texts share one. Texts of under SHORT words, whose few runs an edit takes a good part of,
have keys of two runs; those just above, which can be linked with shorter ones, have both. Either way 95 % of linked
pairs and more share a key.

Of each bucket (band key), all texts are compared with one of them, its centre. That puts large groups together at a
cost linear in a bucket's size. The rest is exact: the texts of buckets that still hold several groups are dealt to
blocks, near ones together and none with many more than BLOCK_WORDS words or BLOCK_TEXTS texts; linked texts must share so
many pairs of neighbouring words that a good part is among the rarest of each, so the blocks that share as many of these
(each counted once a block, however many of its texts have it) make a tile, and in each tile all texts of different groups whose lengths and words allow it are aligned. Only texts that
share as much with the other block go to a tile. Only links leave a
tile. No link between two texts of one bucket is lost, whatever its size; a text travels once per tile, not once per
pair. Two texts are linked if their word edit distance is at most ``1 - similarity`` of the longer one's length, found
by alignment within that band of diagonals. Classes are the connected components, named by their least doc_id.

With 20 % of the words replaced, inserted or deleted, at random or evenly spread, 95 % of pairs and more share a bucket
at every length (a test measures it); with 10 %, all do.

Equal texts count once, by a 64-bit hash of the text (among 10^10 different texts some three pairs are expected to
collide; such a pair would count as equal), and are never compared or paired with each other.
Rows with the same doc_id are the same document. Texts of under five words are linked if their words are equal.

Nulls: a null text is an empty text; texts without a word are alike only if they are equal. A row with a null doc_id
has no class and stays out of every group. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, partitions, words_of, written
from .components import components
from .tokenizing import release

SHINGLE, SIMILARITY = 2, 0.8
BANDS, TAKEN = 128, 4
#: The same of texts with fewer than SHORT words.
SHORT, SHORT_BANDS, SHORT_TAKEN = 64, 32, 2
#: Words and texts of a block that is compared with itself and other blocks; counters of a text's words there.
BLOCK_WORDS, BLOCK_TEXTS, WORD_SLOTS = 200_000, 2000, 2048
#: Counters, up to 255, of how many texts have a pair of words. They only order the pairs: that decides the cost, never
#: the result.
SLOTS, PARTS = 1 << 24, 64
#: Texts that a Python worker holds at once.
TEXTS_AT_ONCE = 250
#: A block's texts: their rarest pairs of words, each once, with the least and greatest component that has it; the nodes
#: whose pairs other groups of the block have; and all nodes, their words, and the places of their pairs, packed.
PACKED = "block long, m int, grams array<long>, c1 array<long>, c2 array<long>, own array<long>, nodes binary, ns binary, sizes binary, places binary"
#: Pairs of words that a block shares with others, of which a task takes as many at once.
SLICE_GRAMS = 1_000_000
#: Ids are broadcast up to this many (8 MB), joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Partners of a text that share one task's copy of its words.
SALT = 256


# ---- signatures

def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 2**63, 512, dtype=np.uint64)
_TIMES = _RNG.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _labelled(values: np.ndarray) -> np.ndarray:
    """Hashes of values, each with how often it has occurred before."""
    n = len(values)
    by_value = np.argsort(values, kind="stable")
    ordered = values[by_value]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    seen = np.empty(n, np.int64)
    seen[by_value] = np.arange(n) - np.repeat(first, np.diff(first, append=n))
    return _splitmix(values + seen.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def order_minhash(words: np.ndarray, bands: int = BANDS, taken: int = TAKEN, shingle: int = SHINGLE) -> np.ndarray:
    """The band keys of a text, given its words' 64-bit hashes; none for a text without words."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = words.astype(np.uint64)
    k = min(shingle, len(words))
    n = len(words) - k + 1
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        runs ^= runs >> np.uint64(29)
    runs = _splitmix(runs)
    elements = _labelled(runs)
    keys = np.empty(bands, np.uint64)
    step = max(1, 500_000 // n)  # what fits a processor's cache
    for at in range(0, bands, step):
        end = min(bands, at + step)
        h = (elements[None, :] ^ _FLIP[at:end, None]) * _TIMES[at:end, None]
        rows, places = np.arange(end - at), []
        for _ in range(min(taken, n)):
            place = h.argmin(axis=1)
            places.append(place)
            h[rows, place] = np.uint64(2**64 - 1)
        key = np.arange(at, end, dtype=np.uint64) + np.uint64(taken << 32)
        for place in np.sort(np.array(places), axis=0):
            key = _splitmix(key * np.uint64(0x9E3779B97F4A7C15) + runs[place])
        keys[at:end] = key
    return keys.view(np.int64)


def keys_of(words: np.ndarray, bands: int = BANDS, taken: int = TAKEN, similarity: float = SIMILARITY) -> np.ndarray:
    """A text's band keys: those of long texts, of short ones, or of both where it can be linked with either."""
    found = []
    if len(words) >= similarity * SHORT:
        found.append(order_minhash(words, bands, taken))
    if len(words) < SHORT:
        found.append(order_minhash(words, SHORT_BANDS, SHORT_TAKEN))
    return np.concatenate(found)


def signatures(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, taken: int = TAKEN) -> DataFrame:
    """node (the text's hash), keys: one row for each distinct text of docs that has a doc_id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for frame in frames:
            keys = [keys_of(np.asarray(w, np.int64), bands, taken, similarity) for w in frame["words"]]
            yield pd.DataFrame({"node": frame["node"], "keys": keys})

    rows = docs.where("doc_id is not null").select(node_of("text").alias("node"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    return rows.mapInPandas(run, "node long, keys array<long>").groupBy("node").agg(F.first("keys").alias("keys"))


def node_of(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


# ---- alignment

def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """The edit distance of two word sequences, or most + 1 if it is more: bit-parallel, with only the 2 * most + 1
    diagonals held on which an alignment of that cost can run."""
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    start = min(start, min(len(a), len(b)) - end)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    band = min(most, len(a))
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    # bit r of a vector in column j is row j + r - band of the pattern a (both from 0)
    top, target = 2 * band, len(a)
    full = (1 << top + 1) - 1
    plus, minus = full >> band << band, 0  # vertical differences before the first column: +1 from row 0 on
    # the score follows the band's lowest row down to the pattern's last row, then along it
    score, give_up = band, 2 * most + 1
    for j, w in enumerate(b):
        shift = j - band
        eq = places.get(w, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = (((eq & plus) + plus ^ plus) | eq | minus) & full
        hp = minus | full ^ (d0 | plus)
        hn = d0 & plus
        if (past := j + band + 1 - target) <= 0:
            score += not d0 >> top & 1
        else:
            score += (hp >> top - past & 1) - (hn >> top - past & 1)
        if score > give_up:
            return most + 1
        d0 >>= 1
        plus = hn | full ^ (d0 | hp)
        minus = d0 & hp
    return min(score, most + 1)


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: the words of the longer that the other lacks, with repeats."""
    both = np.concatenate([a, b])
    values, at = np.unique(both, return_inverse=True)
    ca, cb = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return max(len(a), len(b)) - int(np.minimum(ca, cb).sum())


def linked(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    """Whether two word sequences are alike enough."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
    if not len(x) or not len(y) or bag_distance(x, y) > most:
        return False
    return edit_distance(x.tolist(), y.tolist(), most) <= most


# ---- candidates and links

def _words(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, words (32-bit hashes) of these nodes' texts."""
    if nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    rows = docs.where("doc_id is not null").select(node_of("text").alias("node"), "text").join(nodes, "node", "left_semi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"node": frame["node"], "n": [len(w) for w in frame["words"]], "words": [np.asarray(w, "int32").tobytes() for w in frame["words"]]})

    hashed = rows.select("node", F.transform(words_of(F.col("text")), lambda w: F.hash(w)).alias("words"))
    return hashed.mapInPandas(run, "node long, n int, words binary").groupBy("node").agg(F.first("n").alias("n"), F.first("words").alias("words"))


def _with_words(pairs: DataFrame, words: DataFrame, side: str, other: str) -> DataFrame:
    """pairs with words_<side>. A text with many partners has copies of its words in several tasks."""
    salts = pairs.groupBy(side).agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    copies = words.select(F.col("node").alias(side), "words").join(salts, side).select(side, F.col("words").alias(f"words_{side}"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = pairs.join(salts, side).withColumn("salt", F.pmod(F.xxhash64(other), F.col("salts")).cast("int")).drop("salts")
    return dealt.join(copies, [side, "salt"]).drop("salt")


def _compare(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with linked."""
    both = _with_words(_with_words(pairs.select("a", "b"), words, "a", "b"), words, "b", "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [linked(x, y, similarity) for x, y in zip(frame["words_a"], frame["words_b"])]
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "linked": said})

    return written(both.select("a", "b", "words_a", "words_b").mapInPandas(run, "a long, b long, linked boolean"), "compared", batch=TEXTS_AT_ONCE)


def _fits(a, b, similarity: float):
    """Whether numbers of words allow a link: the edit distance is at least their difference."""
    return F.abs(a - b) <= F.floor(F.lit(1 - similarity) * F.greatest(a, b) + 1e-9)


def _grams(words: bytes) -> np.ndarray:
    """Hashes of a text's pairs of neighbouring words, each with how often it has occurred before."""
    w = np.frombuffer(words, "<u4").astype(np.uint64)
    return _labelled(_splitmix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])) if len(w) > 1 else np.zeros(0, np.uint64)


def _counts(members: DataFrame) -> np.ndarray:
    """For each slot how many labelled pairs of words of members (words) fall into it: a table of a fixed size, of which
    each task sends its counts, mostly zeros, compressed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.uint8)
        for frame in frames:
            for at in range(0, len(frame), TEXTS_AT_ONCE):
                slots, counts = np.unique(_slots(np.concatenate([_grams(w) for w in frame["words"].iloc[at : at + TEXTS_AT_ONCE]])), return_counts=True)
                total[slots] = np.minimum(total[slots] + counts, 255)
        press = zstandard.ZstdCompressor(3)
        yield pd.DataFrame({"part": range(PARTS), "counts": [press.compress(x.tobytes()) for x in np.split(total, PARTS)]})

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS // PARTS, np.int64)
        for frame in frames:
            for x in frame["counts"]:
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
        yield pd.DataFrame({"part": [int(key[0])], "counts": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    with batches_of(members.sparkSession, TEXTS_AT_ONCE):
        rows = members.select("words").mapInPandas(run, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in sorted(rows, key=lambda r: r["part"])] or [np.zeros(SLOTS, np.uint8)])


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(SLOTS - 1)).astype(np.int64)


def shared_least(n):
    """How many of their rarest pairs of words two linked texts share, by the shorter one's number of words."""
    return n // 8 + 1


def rarest(words: bytes, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The rarest of a text's labelled pairs of words: so many that a linked text has shared_least() of them among its
    own. Pairs that no other text has are left out.

    An edit changes two pairs at most. Of texts of n <= m words that are linked, with m - 1 and n - 1 pairs, at least
    m - 1 - 2 (1 - similarity) m >= (2 similarity - 1) n - 1 are therefore shared; of the pairs in one order for all
    texts, as many as are not needed for that, and t more, hold at least t that are.
    """
    own = _grams(words)
    n = len(own) + 1
    least = max(1, int(np.ceil((2 * similarity - 1) * n - 1 - 1e-9)))
    often = counts[_slots(own)]
    order = np.lexsort((own, often))[: max(0, n - 1 - least + shared_least(n))]
    return own[order][often[order] > 1].view(np.int64)


def links_of(frame: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) among texts (node, component, block, words) of two blocks, or of one, enough to join all groups that
    links of theirs join. Counts of hashed words, of which texts share no less than of words, rule most pairs out."""
    raw = frame["words"].tolist()
    texts = [np.frombuffer(w, "<u4") for w in raw]
    n = np.array([len(t) for t in texts])
    held = np.zeros((len(texts), WORD_SLOTS), np.uint8)
    for i, t in enumerate(texts):
        held[i] = np.minimum(np.bincount(t % WORD_SLOTS, minlength=WORD_SLOTS), 255)
    clipped = np.array([len(t) - int(h.sum()) for t, h in zip(texts, held)])
    block, nodes = frame["block"].to_numpy(), frame["node"].tolist()
    group = np.unique(frame["component"].to_numpy(), return_inverse=True)[1]
    low, high = (np.flatnonzero(block == x) for x in (block.min(), block.max()))
    few, many = (low, high) if len(low) <= len(high) else (high, low)
    one, found = block.min() == block.max(), []
    for at, i in enumerate(few.tolist()):
        open_ = many[at + 1 :] if one else many
        open_ = open_[group[open_] != group[i]]
        if not len(open_):
            continue
        longest = np.maximum(n[open_], n[i])
        most = np.floor((1 - similarity) * longest + 1e-9)
        fits = longest - np.minimum(n[open_], n[i]) <= most
        open_, longest, most = open_[fits], longest[fits], most[fits]
        shared = np.minimum(held[open_], held[i]).sum(axis=1, dtype=np.int64) + np.minimum(clipped[open_], clipped[i])
        for j in open_[longest - shared <= most].tolist():
            if group[i] != group[j] and linked(raw[i], raw[j], similarity):
                group[group == group[j]] = group[i]
                found.append((nodes[i], nodes[j]))
    return found


def packed_block(frame: pd.DataFrame, counts: np.ndarray, similarity: float) -> pd.DataFrame:
    """PACKED of a block's texts (node, component, block, words, n, m): each of their rarest pairs of words once, with the
    least and greatest component that has it; and of each text the places of its own among these."""
    found = [rarest(w, counts, similarity) for w in frame["words"]]
    sizes = np.array([len(f) for f in found])
    grams, places = np.unique(np.concatenate(found), return_inverse=True)
    component, text = frame["component"].to_numpy(), np.repeat(np.arange(len(frame)), sizes)
    c1, c2 = np.full(len(grams), 2**63 - 1), np.full(len(grams), -(2**63))
    np.minimum.at(c1, places, component[text])
    np.maximum.at(c2, places, component[text])
    n, m = frame["n"].to_numpy("int64"), int(frame["m"].iloc[0])
    both = np.bincount(text[(c1 != c2)[places]], minlength=len(frame))
    own = frame["node"].to_numpy()[both >= shared_least(np.minimum(n, m))]  # may be linked with a text of the same block
    packed = {"nodes": frame["node"].to_numpy("<i8"), "ns": n.astype("<i8"), "sizes": sizes.astype("<i8"), "places": places.astype("<i4")}
    return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "m": [m], "grams": [grams], "c1": [c1], "c2": [c2], "own": [own]} | {k: [x.tobytes()] for k, x in packed.items()})


def sides_of(texts: pd.DataFrame, meets: pd.DataFrame) -> pd.DataFrame:
    """node, block, other: the texts of a block (PACKED) that share enough of their rarest pairs of words with each other
    block of meets (other, its shortest text's m words, shared: pairs that both blocks have)."""
    x, out = texts.iloc[0], [pd.DataFrame({"node": [], "block": [], "other": []}, dtype="int64")]
    nodes, n, sizes = (np.frombuffer(x[k], "<i8") for k in ("nodes", "ns", "sizes"))
    grams, places, text = np.asarray(x["grams"]), np.frombuffer(x["places"], "<i4"), np.repeat(np.arange(len(nodes)), sizes)
    for other, m, shared in zip(meets["other"].tolist(), meets["m"].tolist(), meets["shared"]):
        there = np.zeros(len(grams), bool)
        there[np.searchsorted(grams, np.asarray(shared))] = True
        count = np.bincount(text[there[places]], minlength=len(nodes))
        out.append(pd.DataFrame({"node": nodes[count >= shared_least(np.minimum(n, m))], "block": int(x["block"]), "other": other}))
    return pd.concat(out)


def _blocks(members: DataFrame) -> DataFrame:
    """members (node, component, home, n) with block and its shortest text's m words: texts of one home in as many blocks
    as their words and number need."""
    need = members.groupBy("home").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_WORDS), F.ceil(F.count("*") / BLOCK_TEXTS)).alias("k"))
    dealt = members.join(need, "home").select("node", "component", F.xxhash64("home", F.pmod(F.xxhash64("node"), "k")).alias("block"), "n")
    return dealt.join(dealt.groupBy("block").agg(F.min("n").alias("m")), "block")


def _rest(entries: DataFrame, grouped: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between groups of texts that meet in a bucket of several groups: all that join groups."""
    if similarity <= 0.5:
        raise ValueError("pairs of words tell nothing about texts of a similarity of 0.5 or less")
    rows = entries.join(grouped, "node", "left").select("bucket", "node", "centre", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("m > 2 and c1 != c2").select("bucket")
    nodes = rows.join(mixed, "bucket", "left_semi").groupBy("node", "component").agg(F.min("centre").alias("home"))
    blocks = written(_blocks(nodes.join(words.select("node", "n"), "node")), "blocks")
    members = written(words.select("node", "words").join(blocks, "node"), "members")
    counts = members.sparkSession.sparkContext.broadcast(_counts(members))

    # of a block's texts that have a pair of words in common, other blocks meet the pair once
    dealt = members.repartition(partitions(members.sparkSession), "block").groupBy("block")
    packed = written(dealt.applyInPandas(lambda frame: packed_block(frame, counts.value, similarity), PACKED), "packed")
    rare = packed.select("block", "m", F.inline(F.arrays_zip("grams", "c1", "c2"))).withColumnRenamed("grams", "gram")
    several = rare.groupBy("gram").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 != c2").select("gram")
    held = written(rare.select("gram", "block", "m").join(several, "gram", "left_semi"), "held")  # read twice
    shared = held.join(held.toDF("gram", "other", "other_m"), "gram").where("block < other").groupBy("block", "other").agg(F.collect_list("gram").alias("shared"), F.first("m").alias("m"), F.first("other_m").alias("other_m"))
    shared = written(shared.where("size(shared) > least(m, other_m) div 8"), "shared")  # shared_least()

    # a text goes where it meets a block that shares enough with it; of a block's others some at a time
    meets = shared.select("block", "other", F.col("other_m").alias("m"), "shared").union(shared.select(F.col("other"), "block", "m", "shared"))
    slices = meets.groupBy("block").agg(F.ceil(F.sum(F.size("shared")) / SLICE_GRAMS).cast("int").alias("slices"))
    meets = meets.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("other"), F.col("slices")).cast("int")).drop("slices")
    texts = packed.drop("c1", "c2", "m", "own").join(slices, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    sides = texts.groupBy("block", "slice").cogroup(meets.groupBy("block", "slice")).applyInPandas(sides_of, "node long, block long, other long")
    sides = sides.union(packed.select(F.explode("own").alias("node"), "block", F.col("block").alias("other")))
    sides = written(sides.select("node", "block", "other", F.xxhash64(F.least("block", "other"), F.greatest("block", "other")).alias("tile")), "sides")
    tiles = sides.groupBy("tile").agg(F.count("*").alias("k"), F.max(F.col("block") == F.col("other")).alias("own"), F.min("block").alias("low"), F.max("block").alias("high")).where("k > 1 and (own or low != high)")
    sides = sides.join(tiles.select("tile"), "tile", "left_semi").select("node", "tile")

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_of(frame, similarity), columns=["a", "b"]).astype("int64")

    # tiles are few bytes and much work, so their number of tasks is not left to sizes
    dealt = members.join(sides, "node").repartition(partitions(members.sparkSession), "tile")
    return written(dealt.groupBy("tile").applyInPandas(tile, "a long, b long"), "rest")


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, taken: int = TAKEN) -> DataFrame:
    """node, class_id for each distinct text of docs (doc_id, text) that has a doc_id."""
    entries = signatures(docs, similarity, bands, taken).select("node", F.explode("keys").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre != last").select("bucket", "centre")
    entries = written(entries.join(shared, "bucket"), "entries", batch=TEXTS_AT_ONCE)
    words = written(_words(docs, entries.select("node").distinct()), "words", batch=TEXTS_AT_ONCE)
    sizes = words.select("node", "n")
    stars = entries.where("node != centre").select("node", "centre").distinct().join(sizes, "node").join(sizes.toDF("centre", "cn"), "centre")
    stars = written(stars.select(F.col("node").alias("a"), F.col("centre").alias("b"), _fits(F.col("n"), F.col("cn"), similarity).alias("fits")), "stars")
    compared = _compare(stars.where("fits"), words, similarity).union(stars.where("not fits").select("a", "b", F.lit(False).alias("linked")))
    grouped = components(compared.where("linked").select("a", "b"))

    links = compared.where("linked").select("a", "b").union(_rest(entries, grouped, words, similarity))

    # classes are made of documents, so a component's least member is its name; rows with one doc_id are one document
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), node_of("text").alias("node"))
    nodes = written(named.groupBy("node").agg(F.min("doc").alias("doc")), "nodes")
    doc = lambda side: nodes.select(F.col("node").alias(side), F.col("doc").alias(f"doc_{side}"))
    linked_docs = links.join(doc("a"), "a").join(doc("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    several = named.groupBy("doc").agg(F.min("node").alias("n1"), F.max("node").alias("n2")).where("n1 != n2").select("doc")
    own = named.join(several, "doc", "left_semi").distinct().join(nodes.withColumnRenamed("doc", "least"), "node").select(F.col("doc").alias("a"), F.col("least").alias("b"))
    found = components(linked_docs.union(own)).toDF("doc", "class_id")
    return written(nodes.join(found, "doc", "left").select("node", F.coalesce("class_id", "doc").alias("class_id")), "classes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id for each row: documents of one class are linked, directly or over others."""
    found = classes(docs, similarity)
    rows = docs.select(F.col("doc_id").cast("long"), node_of("text").alias("node"))
    return rows.join(found, "node", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each class (its least doc_id; one row, if rows repeat). Rows without a
    doc_id stay."""
    found = classes(docs, similarity)
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), node_of("text").alias("node"))
    dropped = written(named.join(found, "node").where("doc_id != class_id").select("doc_id").distinct(), "dropped")
    gone = F.broadcast(dropped) if dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else dropped
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = named.join(dropped, "doc_id", "left_anti").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
