"""Centroid clustering, the conversation trie and toxicity, against brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import centroids, prefix_trie, toxicity

SF = "/root/testdata/sf0.001"


# ---- clustering

def lloyd(rows, k, rounds, dim, seed="2:"):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centre = [v for _, v in named[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        own = [[] for _ in centre]
        for _, v in kept:
            own[assign(v)[1]].append(v)
        centre = [[sum(col) // len(vs) for col in zip(*vs)] if vs else c for c, vs in zip(centre, own)]
    said = [(i, *assign(v)[::-1]) for i, v in kept] if centre else []
    part = {j: sum(d for _, c, d in said if c == j) for j in range(len(centre))}
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, c, d, part[c], sum(part.values()), digest[c]) for i, c, d in said), key=str)


@pytest.mark.parametrize("k", [5, 400])
def test_clusters_equal_plain_lloyd(spark, k):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4) / 8, 1)]) for i in range(150)]
    rows += [(3, rows[3][1]), (3, rows[9][1]), (None, rows[5][1]), (500, None), (501, [1.0] * 3), (502, []), (503, [1.0, None, 1.0, 1.0]), (504, [float("nan")] * 4), (505, [float("inf")] * 4), (506, [-7.0] * 4)]
    rows += [(600 + i, rows[7][1]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "v": F.lit(1)}).repartition(5)
    found = centroids.clustered(df, k=k, rounds=3, dim=4).collect()
    assert sorted((tuple(r) for r in found), key=str) == lloyd(rows, k, 3, 4)


def test_no_vectors_no_clusters(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.clustered(spark.createDataFrame([], schema), dim=4).collect() == []
    assert centroids.clustered(spark.createDataFrame([(1, [1.0] * 3)], schema), dim=4).collect() == []


def test_components_that_64_bits_cannot_hold_raise(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<float>"), dim=4)
    big = np.array([[2**27, -(2**27)], [0, 0]])
    assert centroids.nearest(big, np.array([[-(2**27), 2**27], [1, 0]]))[1].tolist() == [(2**27 - 1) ** 2 + 2**54, 1]


# ---- the trie

CONVERSATION = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """The trie by sets of prefixes."""
    mark = lambda role, text: sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, mark(role, text), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node], sum(not kids[m] for m in below), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows, parts=5):
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({"pos": F.lit("clash"), "node": F.lit(0)})
    return sorted((tuple(r)[:8] for r in prefix_trie.conversation_trie(df.repartition(parts)).collect()), key=str)


def test_trie_equals_sets_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)  # digests of ids that go on from text to text
    rng = random.Random(3)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "\U0001f600\u00e9", "", None, "x" * 50]))
    rows = []
    for c in [*range(0, 12), *range(100, 330, 3), -7, -100, -105, 10**12, 10**12 + 1]:
        rows += [(c, t, *turn()) for t in range(rng.randint(1, 9))]
    rows += [(5, 1, "user", "again"), (5, 1, "user", "again"), (5, 1, None, "again"), (5, None, "user", "first"), (5, None, None, None), (None, 1, "user", "nobody's")]
    rows += [(500 + i, t, "user", f"turn {t}") for i in range(60) for t in range(3)]  # a group of copies
    rows += [(777, t, "user", "long") for t in range(120)] + [(700, 0, "user", "long"), (778, 0, "system", "z"), (778, 9, "user", "long")]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    few = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its head is absent, its turn is replaced
    rows = [(few, 0, "user", "gone")]
    assert trie_of(spark, rows) == plain_trie(rows) == [(few, 0, None, 1, 0, 1, 0, sha256(str(few).encode()).hexdigest())]
    assert trie_of(spark, []) == []


def test_preorder_places_hold_subtrees(spark):
    rows = [(c, t, "user", str(c % (t + 2))) for c in range(40) for t in range(4)]
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONVERSATION)).collect()
    assert sorted(r["at"] for r in found) == list(range(1, len(found) + 1))
    by_place = {r["at"]: r for r in found}
    for r in found:
        below = [by_place[i] for i in range(r["at"], r["subtree_end"] + 1)]
        assert all(x["depth"] > r["depth"] for x in below[1:]) and sum(not x["n_children"] for x in below) == r["n_leaves"]


# ---- toxicity

def test_marginals_equal_all_taggings():
    rng = np.random.default_rng(1)
    a = np.array([[1.0, 0.3], [0.6, 2.5]])
    chains = [rng.normal(0, 2, n) for n in (3, 0, 1, 9, 5)]
    found = toxicity.forward_backward(np.concatenate(chains), np.array([len(c) for c in chains]), a)
    expected = []
    for e in chains:
        weight, total = np.zeros(len(e)), 0.0
        for tags in itertools.product((0, 1), repeat=len(e)):
            w = np.exp(sum(x for x, t in zip(e, tags) if t)) * np.prod([a[i, j] for i, j in zip((0, *tags), tags)])
            weight += w * np.array(tags)
            total += w
        expected += list(weight / total)
    assert np.allclose(found, expected, atol=1e-12)


def test_segments_do_not_show():
    rng = np.random.default_rng(2)
    a, counts = np.array([[1.0, 0.3], [0.6, 2.5]]), np.array([300, 64, 65, 1])
    e = rng.normal(-1, 2, counts.sum())
    whole = toxicity.forward_backward(e, counts, a)
    logs, at = [], 0
    for n in counts:
        x = e[at : at + n]
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        last = np.array([0.0, -1e9])
        for t in range(n):
            f[t] = last = np.logaddexp.reduce(last[:, None] + np.log(a), axis=0) + [0, x[t]]
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(np.log(a) + [0, x[t + 1]] + b[t + 1], axis=1)
        logs += list(1 / (1 + np.exp((f + b)[:, 0] - (f + b)[:, 1])))
        at += n
    assert np.allclose(whole, logs, atol=1e-9)


def test_slopes_equal_differences():
    rng = np.random.default_rng(3)
    e, y = rng.normal(0, 1, (2, 4)), rng.random((2, 4)) < 0.4
    there = np.array([[True] * 4, [True, True, True, False]])
    y &= there
    steps = rng.normal(0, 0.5, (2, 2))

    def likelihood(e, steps):
        out = 0.0
        for row, tags, on in zip(e, y, there):
            n = int(on.sum())
            worth = {t: sum(x for x, k in zip(row, t) if k) + sum(steps[i, j] for i, j in zip((0, *t), t)) for t in itertools.product((0, 1), repeat=n)}
            out += worth[tuple(int(k) for k in tags[:n])] - np.logaddexp.reduce(list(worth.values()))
        return out

    by_token, by_step = toxicity._errors(e, y, there, np.exp(steps))
    for slope, at, of in ((by_token, e, lambda d: likelihood(e + d, steps)), (by_step, steps, lambda d: likelihood(e, steps + d))):
        for i in np.ndindex(at.shape):
            d = np.zeros(at.shape)
            d[i] = 1e-5
            assert slope[i] == pytest.approx((of(d) - of(-d)) / 2e-5, abs=1e-6)


def _texts(n=400, seed=8):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["ka", "lo", "mi", "ru", "te"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    out = []
    for i in range(n):
        words, bad = [rng.choice(plain) for _ in range(rng.randint(5, 80))], i % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "grobian", "Vilewords"]))
        out.append((" ".join(words), int(bad)))
    return out


def test_toxic_texts_are_told_and_their_spans_found():
    learn, hold = _texts(), _texts(seed=9)
    model = toxicity.fit(*zip(*learn))
    scores, spans = model.score([t for t, _ in hold])
    assert all((s >= 0.7) == bool(y) for s, (_, y) in zip(scores, hold))
    for found, (text, y) in zip(spans, hold):
        said = {w for a, b in found for w in text[a:b].lower().split()}
        assert said == ({w.lower() for w in text.split()} & {"vileword", "grobian", "vilewords"})
    odd = ["\u0130 grobian vileword vileword", None, "", "12 !", "vileword " * 3 + "ka " * 3]
    scores, spans = model.score(odd)
    assert [odd[0][a:b] for a, b in spans[0]] == ["grobian vileword vileword"] and scores[0] > 0.7 > scores[1] == scores[2] == scores[3]


def test_pieces_of_a_long_text_do_not_show(monkeypatch):
    model = toxicity.fit(*zip(*_texts()))
    texts = [" ".join(t for t, _ in _texts(60, seed)) for seed in (1, 2)] + ["", "x" * 5000, None, "grobian"]
    whole = model.score(texts)
    monkeypatch.setattr(toxicity, "PIECE", 700)
    pieces = model.score(texts)
    words = [0, 1, 2, 4, 5]  # a word of more letters than a piece holds is cut
    assert np.allclose(whole[0][words], pieces[0][words]) and [whole[1][i] for i in words] == [pieces[1][i] for i in words]


def test_nothing_to_learn_from():
    assert toxicity.fit([], []).score(["a", None])[0].tolist() == [0.0, 0.0]
    assert toxicity.fit(["a b", "c"], [1, 1]).score(["a"])[0].tolist() == [1.0]
    assert toxicity.fit(["a b c d", "a b d e", "b c d a", "d a b c"], [1, 0, 1, 0]).score(["a"])[0].tolist() == [0.5]


def test_toxicity_of_rows(spark):
    made = _texts(240)
    docs = [(i, t) for i, (t, _) in enumerate(made)] + [(None, made[0][0]), (3, None), (0, made[0][0]), (900, ""), (901, "grobian " * 20000)]
    labels = [(i, y) for i, (_, y) in enumerate(made)] + [(None, 1), (1, None), (0, 0), (900, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("clash"), "toxic": F.lit(9), "h": F.lit(1)})
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    learned = toxicity.sample(df, marks)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert learned and not {t for t, _ in learned} & {made[i][0] for i in range(240) if held(i)} and dict(learned).get(made[0][0], 1) == 1
    rows = toxicity.score(df, toxicity.train(df, marks)).withColumn("held_out", toxicity.held_out()).collect()
    assert len(rows) == len(docs) and sum(r["held_out"] for r in rows) == sum(held(i) for i, _ in docs if i is not None)
    assert all((r["score"] >= 0.7) == bool(made[r["doc_id"]][1]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] != 3)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, None)}) == 1
    assert toxicity.score(df.where("false"), toxicity.Model()).collect() == []
    assert toxicity.sample(df.where("false"), marks) == [] == toxicity.sample(df, marks.where("false"))


def test_held_out_documents_are_told(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where(toxicity.held_out()).select("score", "toxic").collect()
    said = Counter((r["score"] >= 0.7, r["toxic"]) for r in scored)
    # some of the labels tell of nothing in the text
    assert said[True, 1] > 0.8 * (said[True, 1] + said[False, 1]) and said[True, 0] <= 0.005 * (said[True, 0] + said[False, 0])
