"""Search, scoring, sharding, near-duplicates, decontamination and the pipeline, against brute force."""

import random
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import decontam, lm_scoring, near_dup, sharding, topk_search
from seamline.llm.components import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


# ---- search

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(120)]
    vectors += [(7, vectors[7][1]), (200, None), (250, [1.0] * 5 + [float("nan")]), (300, [1.0] * 5 + [None]), (None, [1.0] * 6), (350, []), (400, vectors[3][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    found = topk_search.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, query_block=2, shard_rows=16).collect()
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, v in {i: v for i, v in fine if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:5]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(expected)
    assert topk_search.top_k(df.where("false"), "vec_id", "embedding", F.lit(True)).count() == 0


def test_repeated_vectors_are_spread(spark):
    one = spark.range(4000).select(F.lit(7).cast("long").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).union(spark.range(50, 51).select("id", F.array(F.lit(1.0), F.lit(0.0))))
    found = topk_search.top_k(one, "vec_id", "embedding", F.col("vec_id") == 50, shard_rows=500)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(50, r, 7, 256 * 256) for r in range(1, 6)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" in plan


def test_large_components_stay_exact():
    a, b = np.array([[2**58 + 1, 3]]), np.array([[5, 7], [1, 1]])
    assert topk_search._product(a, b).tolist() == [[5 * (2**58 + 1) + 21, 2**58 + 4]]
    with pytest.raises(ArithmeticError):
        topk_search._product(a, a)


# ---- scoring

def test_scores_equal_a_plain_count(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randint(1, 30))) for _ in range(40)] + [None, "", "...", "unique words here", "a b c", "a b c"]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("block", F.lit("clash"))
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    total = {k: sum((grams(words(t), k) for t in texts), Counter()) for k in (1, 2, 3)}
    n = sum(total[1].values())
    expected = []
    for t in texts:
        w = words(t)
        own = {k: grams(w, k) for k in (1, 2, 3)}
        left = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        s = 0.0
        for i in range(len(w)):
            longest = min(i + 1, 3)
            for k in range(longest, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if left(g) > 0:
                    s += log10(left(g) / (left(g[:-1]) if k > 1 else n - len(w))) + (longest - k) * log10(0.4)
                    break
            else:
                s += -log10(n) + (longest - 1) * log10(0.4)
        expected.append((len(w), round(s, 6) if w else None))
    got = [(r["n_tokens"], None if r["log10_sum"] is None else round(r["log10_sum"], 6)) for r in lm_scoring.score(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert lm_scoring.score(df.where("false")).count() == 0


def test_many_blocks_and_parts_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once = {r["doc_id"]: r["log10_sum"] for r in lm_scoring.score(docs).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 60_000)
    monkeypatch.setattr(lm_scoring, "PART_NGRAMS", 20_000)
    for r in lm_scoring.score(docs).collect():
        assert r["log10_sum"] == pytest.approx(once[r["doc_id"]])


# ---- sharding

def test_table_is_balanced_and_moves_little():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    after = sharding.fill_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, after) if names[a] != "s9") < 0.15 * 1009


def plain_table(names, size):
    """Shards in turn take the first free slot of their order of preference, looked for from the order's beginning."""
    import hashlib

    slots = {}
    while True:
        for number, name in enumerate(names):
            if len(slots) == size:
                return [slots[s] for s in range(size)]
            digest = hashlib.sha256(name.encode()).digest()
            start, step = int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big") % (size - 1) + 1
            slots[next(s for k in range(size) if (s := (start + k * step) % size) not in slots)] = number


def test_a_key_named_like_the_result_stays(spark):
    df = spark.createDataFrame([("a", 1)], "slot string, shard int")
    assert sharding.place(df, "slot", ["x", "y"], 211).columns == ["slot_", "slot", "shard"]
    assert sharding.place(df, "slot", ["x", "y"], 211).first()["slot"] == "a"


def test_place_equals_a_plain_lookup(spark):
    import hashlib

    names = [f"s{i}" for i in range(7)]
    table = plain_table(names, 211)
    assert table == sharding.fill_table(names, 211)
    df = spark.createDataFrame([(1,), (None,), (2,), (2,)], "k long").withColumn("slot", F.lit("clash"))
    for r in sharding.place(df, "k", names, 211).collect():
        slot = int(hashlib.md5(str("\0" if r["k"] is None else r["k"]).encode()).hexdigest()[:8], 16) % 211
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert sharding.place(df, "k", names, 211).count() == 4 and sharding.place(df.where("false"), "k", names, 211).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "k")
    sharding.write_shards(df, f"file://{tmp_path}/s", "k", ["a", "b", "c"], 211)
    assert sorted(r["k"] for r in spark.read.parquet(f"file://{tmp_path}/s").collect()) == list(range(500))


# ---- near-duplicates

def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_full():
    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randint(0, 3)] * rng.randint(0, 1)
        most = rng.randint(0, 8)
        assert near_dup.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_bag_distance_is_a_lower_bound():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert near_dup.bag_distance(np.array(a), np.array(b)) <= plain_distance(a, b)


def corpus(rng, groups=12, size=60):
    vocabulary = [f"w{i}" for i in range(500)]
    rows, truth, k = [], {}, 0
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for copy in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(copy):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((k, " ".join(w)))
            truth[k] = g
            k += 1
    return rows, truth


def test_classes_equal_brute_force(spark):
    rng = random.Random(11)
    rows, truth = corpus(rng)
    shared = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, shared + " " + " ".join(f"z{i}x{j}" for j in range(40))) for i in range(12)]  # a common passage is no copy
    texts = [words(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            longest = max(len(texts[i]), len(texts[j]))
            if plain_distance(texts[i], texts[j]) <= int(0.2 * longest + 1e-9):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    expected = {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_copies_among_many_texts_with_a_common_passage(spark):
    passage = [f"p{i}" for i in range(70)]
    rows, expected = [], {}
    for g in range(300):
        own = [f"o{g}x{j}" for j in range(30)]
        rows.append((2 * g, " ".join(passage + own)))
        expected[2 * g] = 2 * g
        if g < 60:  # a copy with every other own word changed: no own run of five is left, 15 of 100 words differ
            rows.append((2 * g + 1, " ".join(passage + [w if j % 2 else f"c{g}x{j}" for j, w in enumerate(own)])))
            expected[2 * g + 1] = 2 * g
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_a_block_meets_others_once_by_each_pair_of_words(spark, monkeypatch):
    seen, keep = {}, near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, name, *a, **b: seen.setdefault(name, keep(df, name, *a, **b)) if name == "held" else keep(df, name, *a, **b))
    passage = [f"p{i}" for i in range(70)]
    rows = [(g, " ".join(passage + [f"o{g}x{j}" for j in range(30)])) for g in range(200)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["class_id"] for r in got)
    assert seen["held"].count() > 0 and seen["held"].groupBy("gram", "block").count().where("count > 1").isEmpty()


def test_linked_texts_share_one_of_their_rarest_pairs_of_words(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(near_dup, "SLOTS", 128)
    counts = np.array([rng.randint(2, 9) for _ in range(128)])
    linked = 0
    for _ in range(3000):
        a = [rng.randint(0, 12) for _ in range(rng.randint(2, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randint(0, 12)] * rng.randint(0, 1)
        a, b = (np.array(x, np.uint32).tobytes() for x in (a, b))
        if len(b) > 4 and near_dup.linked(a, b):
            linked += 1
            shared = set(near_dup.rarest(a, counts).tolist()) & set(near_dup.rarest(b, counts).tolist())
            assert len(shared) >= near_dup.shared_least(min(len(a), len(b)) // 4)
    assert linked > 500


def test_tiles_join_all_that_links_join():
    import pandas as pd

    rng = random.Random(5)
    texts = [[rng.randint(0, 60) for _ in range(rng.randint(20, 30))] for _ in range(12)]
    for k in range(40):
        w = list(texts[rng.randrange(len(texts))])
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.randint(0, 60)
        texts.append(w)
    texts += [[7] * 300 + [1, 2], [7] * 290]
    for blocks in (1, 2):
        frame = pd.DataFrame({"node": range(len(texts)), "component": range(len(texts)), "block": [i % blocks for i in range(len(texts))], "words": [np.array(t, "<u4").tobytes() for t in texts]})
        every = [(i, j) for i in range(len(texts)) for j in range(i) if (blocks == 1 or i % 2 != j % 2) and plain_distance(texts[i], texts[j]) <= int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)]
        assert len(every) > 20 and groups_of(len(texts), near_dup.links_of(frame, 0.8)) == groups_of(len(texts), every)


def groups_of(n, links):
    group = list(range(n))
    for a, b in links:
        x, y = group[a], group[b]
        group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def changed(rng, w, kind):
    """w with a fifth of it replaced, inserted, deleted or a mixture."""
    w, n = list(w), len(w)
    if kind.startswith("every"):
        step = int(kind[5:])
        for at in range(rng.randrange(step), n, step):
            w[at] = f"e{at}x{rng.getrandbits(40)}"
        return w
    for k in range(n // 4 if kind == "insert" else n // 5):
        do = kind if kind != "mixed" else rng.choice(["replace", "insert", "delete"])
        at = rng.randrange(len(w))
        if do == "insert":
            w.insert(at, f"i{k}x{rng.getrandbits(40)}")
        elif do == "delete":
            del w[at]
        else:
            w[at] = f"r{k}x{rng.getrandbits(40)}"
    return w


@pytest.mark.parametrize("kind", ["replace", "insert", "delete", "mixed", "every5", "every6", "every7"])
def test_candidate_recall_at_the_limit(kind):
    import xxhash

    rng = random.Random(17)
    hash_ = lambda w: np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64)
    for n in (6, 10, 20, 40, 55, 63, 64, 65, 70, 100, 300, 1000):
        met = tried = 0
        while tried < 80:
            a = [f"g{tried}w{j}" for j in range(n)]
            b = changed(rng, a, kind)
            if kind.startswith("every") and plain_or_banded(a, b) > int(0.2 * n + 1e-9):
                continue  # one edit more than the length allows
            assert plain_or_banded(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
            tried += 1
            met += bool(set(near_dup.keys_of(hash_(a)).tolist()) & set(near_dup.keys_of(hash_(b)).tolist()))
        assert met >= 0.95 * 80, (n, met)


def plain_or_banded(a, b):
    number = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    return near_dup.edit_distance([number[w] for w in a], [number[w] for w in b], max(len(a), len(b)))


def test_odd_documents(spark):
    long = " ".join(f"v{i % 977}y{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, long), (7, long.replace("v5y5 ", "")), (8, "!!!"), (9, "hi"), (10, "hi"), (11, "first text of a twice used id"), (11, "another text entirely, same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("class_id", F.lit("clash"))
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["class_id"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [((False, 0), None), ((True, 1), 1), ((True, 2), 1), ((True, 4), 4), ((True, 5), 4), ((True, 5), 4), ((True, 6), 6), ((True, 7), 6), ((True, 8), 8), ((True, 9), 9), ((True, 10), 9), ((True, 11), 11), ((True, 11), 11)]
    kept = near_dup.dedup(df)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 6, 8, 9, 11] and kept.columns == df.columns
    assert near_dup.near_duplicates(df.where("false")).count() == 0 and near_dup.dedup(df.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 101), (200, 200), (None, 3), (300, 301)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 50, 50: 50, 101: 50, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = spark.range(1, 300).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in components(path).collect()} == {1}


# ---- decontamination

def test_leaks_equal_brute_force(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(20, 50)))) for i in range(15)] + [(20, "only three words"), (21, None), (22, "")]
    docs = []
    for k in range(60):
        w = say(rng.randint(5, 120))
        if k % 2:
            item = words(items[rng.randrange(15)][1])
            for _ in range(k % 3):
                item[rng.choice([0, 1, -1, -2])] = "changed"
            if k % 5 == 0:
                item = item[: len(item) // 2]  # half an item is no leak
            at = rng.randint(0, len(w))
            w = w[:at] + item + w[at:]
        docs.append((k, " ".join(w).upper() if k % 7 == 0 else ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "so only three words, said"), (None, items[0][1]), (104, items[1][1]), (104, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("clash"))
    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    expected = set()
    for d, t in docs:
        w = words(t)
        for i, b in items:
            want = words(b)
            if not want or not w:
                continue
            n, target = min(len(want), len(w)), runs(want)
            for s in range(len(w) - n + 1):
                here = runs(w[s : s + n])
                both = sum((here & target).values())
                if both / sum((here | target).values()) >= 0.8:
                    expected.add((d, i))
    got = decontam.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len([r for r in got if r["doc_id"] == 104]) == 2
    leaked = {d for d, _ in expected}
    assert sorted(r["doc_id"] for r in decontam.decontaminate(df, bench).collect()) == sorted(d for d, _ in docs if d not in leaked)
    assert decontam.contaminated(df.where("false"), bench).count() == 0 and decontam.decontaminate(df, bench.where("false")).count() == len(docs)


def test_reordered_items_equal_brute_force(spark):
    rng = random.Random(33)
    items = [(i, [f"i{i}x{j}" for j in range(n)]) for i, n in enumerate([60, 60, 45, 30, 90])]
    docs = []
    for k in range(40):
        i, w = items[k % 5]
        cut = rng.choice([len(w) // 3, len(w) // 2, 3])
        moved = w[cut:] + w[:cut]
        around = [f"d{k}x{j}" for j in range(rng.choice([0, 7, 50]))]
        docs.append((k, " ".join(around + moved + around[: rng.randint(0, 9)])))
    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    expected = {}
    for d, t in docs:
        w = words(t)
        for i, want in items:
            n, target = min(len(want), len(w)), runs(want)
            best = max(sum((runs(w[s : s + n]) & target).values()) / sum((runs(w[s : s + n]) | target).values()) for s in range(len(w) - n + 1))
            if best >= 0.8:
                expected[d, i] = round(best, 6)
    assert len(expected) > 10
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(df, bench).collect()} == expected


def test_items_with_words_put_in_and_taken_out(spark):
    rng = random.Random(44)
    items = [(i, [f"i{i}x{j}" for j in range(n)]) for i, n in enumerate([200, 120, 80, 60])]
    first = items[0][1]
    docs = [(0, " ".join([f"a{j}" for j in range(40)] + ["c"] * 8 + first[8:100] + [f"n{j}" for j in range(16)] + first[100:192] + ["d"] * 8 + [f"b{j}" for j in range(40)]))]
    for k in range(1, 40):
        w = list(items[k % 4][1])
        for _ in range(rng.randint(1, 4)):
            at, m = rng.randrange(len(w)), rng.randint(1, 8)
            if rng.random() < 0.5:
                w[at:at] = [f"n{k}x{j}" for j in range(m)]
            else:
                del w[at : at + m]
        docs.append((k, " ".join([f"d{k}x{j}" for j in range(rng.choice([0, 30]))] + w + [f"e{k}x{j}" for j in range(rng.choice([0, 30]))])))
    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    expected = {}
    for d, t in docs:
        w = words(t)
        for i, want in items:
            n, target = min(len(want), len(w)), runs(want)
            best = max(sum((runs(w[s : s + n]) & target).values()) / sum((runs(w[s : s + n]) | target).values()) for s in range(len(w) - n + 1))
            if best >= 0.8:
                expected[d, i] = round(best, 6)
    assert expected[0, 0] == pytest.approx(0.8148, abs=1e-4) and len(expected) > 10
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(df, bench).collect()} == expected


@pytest.mark.parametrize("n", [30, 100, 400])
def test_radius_holds_windows_at_the_limit(spark, n):
    rng = random.Random(n)
    some = lambda k: [rng.getrandbits(63) for _ in range(k)]
    rows = []
    for _ in range(400):
        base = some(n)
        rows.append((base, some(n // 9) + base[n // 9 :]))  # n - n/9 of n + n/9 shingles are shared: 0.8 and little more
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    found = df.select(decontam.weighted_jaccard(F.col("a"), F.col("b")).alias("j"), (F.bit_count(decontam._fingerprint(F.col("a")).bitwiseXOR(decontam._fingerprint(F.col("b")))) <= decontam.RADIUS).alias("near")).collect()
    assert all(0.8 <= r["j"] < 0.85 for r in found) and sum(r["near"] for r in found) >= 0.98 * len(found)


def test_weighted_jaccard_counts_repeats(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 5) for _ in range(rng.randint(1, 9))], [rng.randint(0, 5) for _ in range(rng.randint(1, 9))]) for _ in range(200)]
    for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", decontam.weighted_jaccard(F.col("a"), F.col("b")).alias("j")).collect():
        a, b = Counter(r["a"]), Counter(r["b"])
        assert r["j"] == pytest.approx(sum((a & b).values()) / sum((a | b).values()))


def test_index_finds_every_fingerprint_in_the_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) - 2**63 for _ in range(20)]
    near = []
    for b in base:
        bits = rng.sample(range(64), decontam.RADIUS)
        x = b
        for k in bits:
            x ^= 1 << k
        near.append((x + 2**63) % 2**64 - 2**63)
    one = lambda xs, name: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"{name} long, f long")
    blocks = lambda df, name: df.select(name, decontam._blocks(F.col("f")).alias("b")).select(name, "b.block", "b.value")
    index = blocks(one(base, "item"), "item").select("item", "block", decontam._variants(F.col("block"), F.col("value")).alias("value"))
    pairs = {(r["doc"], r["item"]) for r in blocks(one(near, "doc"), "doc").join(index, ["block", "value"]).select("doc", "item").collect()}
    assert {(i, i) for i in range(20)} <= pairs


# ---- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, out = docs, docs
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == docs.columns
        rows = spark.createDataFrame(out.collect(), docs.schema)
    kept = {r["doc_id"] for r in rows.collect()}
    pieces = P.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == kept
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    leaks = {r["doc_id"] for r in decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert kept == {d for d, c in classes.items() if d == c and d not in leaks}


def test_queries_equal_sql(spark):
    import duckdb

    from seamline.llm import queries

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        pick = lambda cols, rows: sorted(tuple(repr(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
        assert sorted(names) == sorted(df.columns)
        assert pick(df.columns, df.collect()) == pick(names, cur.fetchall()), name


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "the null id of a text that is here", None, None, None), (9001, None, "en", None, 0), (9002, "", None, "s", 0), (9003, "\U0001f600", None, "s", 1)], docs.schema)
    rows = docs.unionByName(odd).unionByName(odd).withColumn("score", F.lit("clash")).withColumn("class_id", F.lit("clash")).withColumn("node", F.lit("clash"))
    rows = rows.withColumns({c: F.lit("clash") for c in ("lang_pred", "rejected", "_node", "own_0_score")})
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns
        assert out.where("score != 'clash' OR lang_pred != 'clash' OR rejected != 'clash' OR _node != 'clash'").count() == 0
        rows = spark.createDataFrame(out.collect(), rows.schema)
    kept = [r["doc_id"] for r in rows.collect()]
    assert not {9001, 9002, 9003} & set(kept) and len(kept) > 20
    assert {r["doc_id"] for r in P.STAGES[-1][1](spark, rows, SF).collect()} == set(kept)
    empty = rows.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_language_stage_gives_python_few_texts_at_once(spark, monkeypatch):
    import corpus_pipeline
    from seamline.llm import language_id

    def predict(docs, model):
        def run(frames):
            for frame in frames:
                yield frame.assign(lang_pred="en", score=float(len(frame)), rejected=len(frame) > 512)

        return docs.mapInPandas(run, docs._jdf.schema().toDDL() + ", lang_pred string, score double, rejected boolean")

    monkeypatch.setattr(language_id, "predict", predict)
    monkeypatch.setattr(language_id, "train", lambda docs: None)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert corpus_pipeline.known_language(spark, docs, SF).count() == 2000


def test_packing_stage_keeps_few_chunks(spark, monkeypatch):
    """Of 8,000 words a worker keeps no more than CHUNKS; the pieces are the same."""
    import corpus_pipeline as P
    from seamline.llm import packing, tokenizing

    class Frames:
        select = lambda self, *columns: self
        mapInPandas = lambda self, run, schema: run

    held, real = [], packing.cut

    def cut(docs, *how):
        tokenizing.release()
        rows = list(real(Frames(), *how)(iter([docs.select("doc_id", "text").toPandas()])))
        held.extend(len(e.known) for e in tokenizing._encoders.values())
        tokenizing.release()
        return spark.createDataFrame(rows[0].astype("int64"), packing.PIECES)

    docs = spark.createDataFrame([(i, " ".join(f"w{5 * i + k}x" for k in range(5))) for i in range(1600)], "doc_id long, text string")
    whole = sorted(map(tuple, P.packed(spark, docs, SF).drop("sequence_id", "offset").collect()))
    monkeypatch.setattr(packing, "cut", cut)
    monkeypatch.setattr(P, "CHUNKS", 6000, raising=False)
    assert sorted(map(tuple, P.packed(spark, docs, SF).drop("sequence_id", "offset").collect())) == whole
    assert len(held) == 1 and 0 < held[0] <= 6000
