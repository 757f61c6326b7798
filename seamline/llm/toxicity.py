"""Toxicity: a linear-chain conditional random field tags toxic tokens, and its marginals make scores and spans.

Tokens are runs of letters, in lower case. A token's features are its character n-grams of 3 to 5 with its borders, and
the whole word, each hashed to a weight; two tags (clean, toxic) with weights for each step between them make the chain.

Labelled tokens. Labels are of documents, so tokens are labelled by evidence first: a feature that at least ``support``
of the toxic documents learned from have, and that is ``lift`` times as frequent among their tokens as among those of
clean ones (up to five of a document count), labels the tokens of toxic documents that have it. The field is then fitted
to these tags in windows of tokens, by stochastic gradient ascent of its likelihood in numpy, and once more with windows
around the tokens of clean documents that it took for toxic. It learns from at most ``per_class`` documents of either
label, chosen by a hash of their id; of equal and near-equal texts (one of four min-hashes of five-word runs in common)
one counts, so that a group of copies does not make words of its own look toxic.

Scores. Forward-backward gives each token's marginal; the odds that any token is toxic go through a rising logistic
function fitted to documents that were kept back. Spans are runs of tokens whose marginal is 0.5 or more, as offsets in
code points (end excluded). Every text is scored whole.

Nulls: a null text is an empty text; a text without a letter has the score that no evidence gives, and no span. Labels
whose doc_id or label is null, and null texts, are not learned from; a document with several labels is toxic if one says
so. Repeated rows each get the same score. Without documents of both labels, or without a token that tells them apart,
every score is the share of toxic ones (0 if there are none). A run of over a million letters counts as several tokens.
An empty table gives an empty result. Only doc_id, text and the label are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORED = "doc_id {doc}, score double, spans array<struct<start: int, end: int>>"
BITS, ORDERS = 19, (3, 4, 5)
#: Characters whose features are made at once.
PIECE = 500_000
#: Tokens of a segment, whose product of step matrices is taken on its own.
SEGMENT = 64
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


# ---- tokens and features

def _codes(text: str) -> np.ndarray:
    """Code points of the text in lower case, one for each character; others than letters as a space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c) == 1 else t for c, t in ((t.lower(), t) for t in text))
    x = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_LETTER[x], x, np.uint32(32))


def _pieces(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text of at most about a million characters, cut between words where there is such a place."""
    at = 0
    while at < len(x):
        end = min(len(x), at + 2 * PIECE)
        if end < len(x):
            gaps = np.flatnonzero(x[at + PIECE : end] == 32)
            end = at + PIECE + int(gaps[-1]) + 1 if len(gaps) else end
        yield at, x[at:end]
        at = end


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(15))


def features(parts: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Of code points: pairs of arrays (row of the weights, token); each token's start and end in its part; its part."""
    border = np.array([32], np.uint32)
    x = np.concatenate([a for p in parts for a in (border, p)] + [border, border, border, border])
    inner = x != 32
    starts = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    ends = np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
    token = np.zeros(len(x), np.int32)
    token[starts] = 1
    np.cumsum(token, out=token)
    token -= 1
    found = []
    n = len(x) - 4
    h, there = np.full(n, 0x61C88647, np.uint32), np.ones(n, bool)
    for k in range(5):
        h = _mix(h, x[k : k + n])
        if k + 1 in ORDERS:
            there &= inner[k - 1 : k - 1 + n]
            where = np.flatnonzero(there)
            found.append(((h[where] & np.uint32((1 << BITS) - 1)).astype(np.int32), token[where + 1]))
    if len(starts):
        letters = np.flatnonzero(inner)
        place = (letters - starts[token[letters]]).astype(np.uint64)
        mixed = (x[letters].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
        words = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
        found.append(((words >> np.uint64(64 - BITS)).astype(np.int32), np.arange(len(starts), dtype=np.int32)))
    heads = np.cumsum([0] + [len(p) + 1 for p in parts])  # where each part's border lies
    part = np.searchsorted(heads, starts, side="right") - 1
    return found, starts - heads[part] - 1, ends - heads[part] - 1, part


# ---- the chain

def _steps(g: np.ndarray, there: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
    """Products of the step matrices of each row of g, entry by entry; where there is no token, nothing happens."""
    m = [np.full(len(g), v) for v in (1.0, 0.0, 0.0, 1.0)]
    for t in range(g.shape[1]):
        q, on = g[:, t], there[:, t]
        new = [m[0] * a[0, 0] + m[1] * a[1, 0], (m[0] * a[0, 1] + m[1] * a[1, 1]) * q, m[2] * a[0, 0] + m[3] * a[1, 0], (m[2] * a[0, 1] + m[3] * a[1, 1]) * q]
        total = new[0] + new[1] + new[2] + new[3]
        m = [np.where(on, x / total, y) for x, y in zip(new, m)]
    return m


def forward_backward(e: np.ndarray, counts: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Each token's marginal of the toxic tag. e: the tokens' log odds, counts: tokens of each chain, a: what a step from
    tag i to tag j is worth. A chain starts after a clean tag. Segments of all chains are gone through side by side."""
    if not len(e):
        return np.zeros(0)
    segments = -(-counts // SEGMENT)
    first = np.concatenate([[0], np.cumsum(segments)[:-1]])
    chain = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.arange(len(e)) - begin[chain]
    row, col = first[chain] + place // SEGMENT, place % SEGMENT
    n = int(segments.sum())
    g, there = np.ones((n, SEGMENT)), np.zeros((n, SEGMENT), bool)
    g[row, col], there[row, col] = np.exp(np.clip(e, -30, 30)), True
    m = [x.tolist() for x in _steps(g, there, a)]
    # odds of the toxic tag before each segment, and what is worth more after it
    r, b = np.zeros(n), np.ones(n)
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)
    filled = segments > 0
    opens[first[filled]], closes[(first + segments - 1)[filled]] = True, True
    value = 0.0
    for i, start in enumerate(opens.tolist()):
        value = 0.0 if start else value
        r[i] = value
        value = (m[1][i] + value * m[3][i]) / max(m[0][i] + value * m[2][i], 1e-300)
    for i, end in zip(range(n - 1, -1, -1), closes[::-1].tolist()):
        value = 1.0 if end else value
        b[i] = value
        value = (m[2][i] + m[3][i] * value) / max(m[0][i] + m[1][i] * value, 1e-300)
    odds = np.empty((n, SEGMENT))
    for t in range(SEGMENT):
        r = np.where(there[:, t], g[:, t] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]), r)
        odds[:, t] = r
    for t in range(SEGMENT - 1, -1, -1):
        odds[:, t] *= b
        b = np.where(there[:, t], (a[1, 0] + a[1, 1] * g[:, t] * b) / (a[0, 0] + a[0, 1] * g[:, t] * b), b)
    odds = odds[row, col]
    return odds / (1 + odds)


@dataclass
class Model:
    #: weights of the features and of being toxic at all, worth of steps, the logistic function's weights
    table: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(2))
    #: every score, where nothing could be learned
    share: float | None = 0.0

    def emissions(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found, starts, ends, part = features(parts)
        e = np.full(len(starts), self.bias)
        for rows, token in found:
            e += np.bincount(token, weights=self.table[rows], minlength=len(starts))
        return e, starts, ends, part

    def marginals(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: the tokens' marginals, starts and ends."""
        parts: list[tuple[int, int, np.ndarray]] = []
        done = []

        def flush() -> None:
            e, starts, ends, part = self.emissions([p for *_, p in parts])
            at = np.searchsorted(part, np.arange(len(parts) + 1))
            for i, (doc, shift, _) in enumerate(parts):
                done.append((doc, e[at[i] : at[i + 1]], starts[at[i] : at[i + 1]] + shift, ends[at[i] : at[i + 1]] + shift))
            parts.clear()

        def ready(until: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """The texts before this one, all of whose parts are done."""
            nonlocal given
            own: list[list] = [[] for _ in range(until - given)]
            for doc, *rest in done:
                own[doc - given].append(rest)
            done.clear()
            joined = [[np.concatenate(x) for x in zip(*rest)] if rest else [np.zeros(0)] * 3 for rest in own]
            counts = np.array([len(x[0]) for x in joined], np.int64)
            p = forward_backward(np.concatenate([x[0] for x in joined]) if joined else np.zeros(0), counts, self.steps)
            at = np.concatenate([[0], np.cumsum(counts)])
            given = until
            for i, (_, starts, ends) in enumerate(joined):
                yield p[at[i] : at[i + 1]], starts, ends

        given, held = 0, 0
        for doc, text in enumerate(texts):
            for shift, piece in _pieces(_codes(text or "")):
                parts.append((doc, shift, piece))
                held += len(piece)
                if held >= 2 * PIECE:
                    flush()
                    held = 0
            if held >= PIECE:
                flush()
                held = 0
            if not held:
                yield from ready(doc + 1)
        if parts:
            flush()
        yield from ready(len(texts))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        if self.share is not None:
            return np.full(len(texts), self.share), [[] for _ in texts]
        scores, spans = np.empty(len(texts)), []
        for i, (p, starts, ends) in enumerate(self.marginals(texts)):
            scores[i] = 1 / (1 + np.exp(-(evidence(p) * self.curve[0] + self.curve[1])))
            hit = np.flatnonzero(p >= 0.5)
            cut = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
            spans.append([(int(starts[hit[a]]), int(ends[hit[b - 1]])) for a, b in zip(cut, [*cut[1:], len(hit)])])
        return scores, spans


def evidence(p: np.ndarray) -> float:
    """Log odds that any token is toxic, within bounds."""
    none = float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
    return float(np.clip(np.log(-np.expm1(min(none, -1e-12))) - none, -10, 20))


# ---- learning

def _rows(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """A text's features (sorted by token) with each token's first place among them, and its number of tokens."""
    found, starts, _, _ = features([_codes(text)])
    rows, token = np.concatenate([r for r, _ in found]), np.concatenate([t for _, t in found])
    order = np.argsort(token, kind="stable")
    return rows[order], np.searchsorted(token[order], np.arange(len(starts) + 1)), len(starts)


def _distinct(texts: list[str]) -> list[int]:
    """The places of texts that share none of four min-hashes of five-word runs with an earlier one."""
    seen: list[set[int]] = [set() for _ in range(4)]
    kept = []
    for i, text in enumerate(texts):
        words = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.lower().split()], np.uint64)
        if len(words) >= 5:
            runs = np.zeros(len(words) - 4, np.uint64)
            for k in range(5):
                runs = runs * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(runs)]
            marks = [int(((runs ^ np.uint64(f)) * np.uint64(0xD6E8FEB86659FD93)).min()) for f in (1 << 7, 1 << 23, 1 << 41, 1 << 59)]
        else:
            marks = [zlib.crc32(text.encode("utf-8", "surrogatepass"))] * 4
        if not any(m in s for m, s in zip(marks, seen)):
            kept.append(i)
        for m, s in zip(marks, seen):
            s.add(m)
    return kept


def fit(texts: list[str], toxic: list[int], support: float = 0.01, lift: float = 10.0, epochs: int = 3, rate: float = 0.3, width: int = 48, seed: int = 3) -> Model:
    """A model of texts and their labels."""
    kept = _distinct(texts)
    texts, labels = [texts[i] for i in kept], np.array([toxic[i] for i in kept], bool)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < labels.sum() < len(labels):
        return Model(share=share)
    rng = np.random.default_rng(seed)
    docs = [_rows(t) for t in texts]
    order = rng.permutation(len(docs))
    back = np.zeros(len(docs), bool)
    for y in (False, True):
        own = order[labels[order] == y]
        back[own[: len(own) // 5]] = True
    learn = np.flatnonzero(~back)

    # evidence: how many documents of either label have a feature, and how often
    have, often, tokens = np.zeros((2, 1 << BITS), np.int64), np.zeros((2, 1 << BITS), np.int64), np.ones(2)
    for i in learn:
        rows, counts = np.unique(docs[i][0], return_counts=True)
        have[int(labels[i])][rows] += 1
        often[int(labels[i])][rows] += np.minimum(counts, 5)
        tokens[int(labels[i])] += docs[i][2]
    strong = (have[1] >= max(3, support * labels[learn].sum())) & (often[1] / tokens[1] >= lift * (often[0] + 0.5) / tokens[0])

    def tags(i: int) -> np.ndarray:
        rows, at, n = docs[i]
        if not labels[i] or not n:
            return np.zeros(n, bool)
        return np.add.reduceat(strong[rows].astype(np.int32), at[:-1]) > 0

    def around(i: int, c: int, y: np.ndarray) -> tuple[int, int, int, np.ndarray]:
        n = docs[i][2]
        a = max(0, min(c - int(rng.integers(0, width)), n - width))
        return i, a, min(n, a + width), y[a : a + width]

    windows = []
    for i in learn:
        n, y = docs[i][2], tags(i)
        hits = np.flatnonzero(y)
        centres = rng.choice(hits, min(6, len(hits)), replace=False) if len(hits) else rng.integers(0, max(n, 1), 3 * (n > 0))
        windows += [around(i, c, y) for c in centres.tolist()]
    if not any(w[3].any() for w in windows):
        return Model(share=share)
    model = _ascend(docs, windows, epochs, rate, width, rng)
    clean = learn[~labels[learn]]
    for i, (p, *_) in zip(clean, model.marginals([texts[i] for i in clean])):
        wrong = np.argsort(-p)[:4]
        windows += [around(i, c, np.zeros(len(p), bool)) for c in wrong[p[wrong] >= 0.1].tolist()]
    model = _ascend(docs, windows, epochs, rate, width, rng)
    check = np.flatnonzero(back) if 0 < labels[back].sum() < back.sum() else np.arange(len(texts))
    x = np.array([evidence(p) for p, *_ in model.marginals([texts[i] for i in check])])
    model.curve = _logistic(x, labels[check].astype(float))
    if not (np.isfinite(model.table).all() and np.isfinite(model.curve).all()):
        raise ArithmeticError("training did not converge")
    return model


def _ascend(docs: list, windows: list[tuple[int, int, int, np.ndarray]], epochs: int, rate: float, width: int, rng: np.random.Generator) -> Model:
    """A model fitted to windows: (document, first token, end, tags)."""
    table, bias, steps = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    seen, seen_bias, seen_steps = np.full(1 << BITS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(epochs):
        shuffled = rng.permutation(len(windows))
        for at in range(0, len(shuffled), 128):
            batch = [windows[j] for j in shuffled[at : at + 128]]
            rows = np.concatenate([docs[i][0][docs[i][1][a] : docs[i][1][b]] for i, a, b, _ in batch])
            token = np.concatenate([np.repeat(np.arange(k * width, k * width + b - a), np.diff(docs[i][1][a : b + 1])) for k, (i, a, b, _) in enumerate(batch)])
            there, y = np.zeros((len(batch), width), bool), np.zeros((len(batch), width), bool)
            for k, (_, a, b, tag) in enumerate(batch):
                there[k, : b - a], y[k, : b - a] = True, tag
            e = bias + np.bincount(token, weights=table[rows], minlength=there.size).reshape(there.shape)
            error, step_error = _errors(e, y, there, np.exp(steps))
            met, which = np.unique(rows, return_inverse=True)
            slope = np.bincount(which, weights=error.ravel()[token]) - 1e-3 * table[met]
            seen[met] += slope**2
            table[met] += rate * slope / np.sqrt(seen[met])
            seen_bias += error.sum() ** 2
            bias += rate * error.sum() / seen_bias**0.5
            seen_steps += step_error**2
            steps += rate * step_error / np.sqrt(seen_steps)
            steps[0, 0] = 0.0  # only differences count
    return Model(table.astype(np.float32), bias, np.exp(steps), np.zeros(2), None)


def _errors(e: np.ndarray, y: np.ndarray, there: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the log likelihood of tags y: of each token's log odds, and of each kind of step."""
    n, width = e.shape
    g = np.exp(np.clip(e, -30, 30))
    before, after = np.empty((n, width)), np.empty((n, width))
    r, b = np.zeros(n), np.ones(n)
    for t in range(width):
        before[:, t] = r
        r = np.where(there[:, t], g[:, t] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]), r)
    for t in range(width - 1, -1, -1):
        after[:, t] = b
        b = np.where(there[:, t], (a[1, 0] + a[1, 1] * g[:, t] * b) / (a[0, 0] + a[0, 1] * g[:, t] * b), b)
    worth = g * after
    pair = np.array([[np.full_like(g, a[0, 0]), a[0, 1] * worth], [before * a[1, 0], before * a[1, 1] * worth]]) * there
    pair /= np.where(there, pair.sum(axis=(0, 1)), 1.0)
    last = np.concatenate([np.zeros((n, 1), bool), y[:, :-1]], axis=1)
    said = np.array([[~last & ~y, ~last & y], [last & ~y, last & y]]) & there
    return (y - pair[:, 1].sum(axis=0)) * there, (said - pair).sum(axis=(2, 3))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope (not below 0.05) and offset of a logistic regression, kept finite by a small penalty. The rarer label weighs
    more, by the root of what the other has more of it, so that a few labels that nothing bears out do not outweigh it."""
    both, w, keep = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2), np.array([1e-2, 1e-4])
    weight = np.where(y > 0, (max(len(y) / y.sum() - 1, 1e-9)) ** 0.25, (max(len(y) / y.sum() - 1, 1e-9)) ** -0.25)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(both @ w, -40, 40)))
        slope = both.T @ (weight * (y - p)) - keep * w
        step = np.linalg.solve((both * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ both + np.diag(keep), slope)
        w = w + step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        w[0] = max(w[0], 0.05)
    return w


# ---- on tables

def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000, longest: int = 50_000) -> list[tuple[str, int]]:
    """Texts and labels to learn from, of documents that are not held out: at most ``per_class`` of each label, by a hash
    of the id, without texts of over ``longest`` characters. So at most 2 x per_class x longest characters reach the
    driver; some 26 MB where texts have 3,300 on average."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # 2 x per_class rows at most
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest)).join(ids, "doc_id")
    rows = rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "text"))).where("place = 1")
    return [(r["text"], r["toxic"]) for r in sorted(rows.collect(), key=lambda r: (r["h"], r["text"]))]


def train(docs: DataFrame, labels: DataFrame, **how) -> Model:
    found = sample(docs, labels, **how)
    return fit([t for t, _ in found], [y for _, y in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, 2 MB

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores, spans = shared.value.score(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": scores, "spans": [[{"start": a, "end": b} for a, b in s] for s in spans]})

    return docs.select("doc_id", "text").mapInPandas(run, SCORED.format(doc=docs.schema["doc_id"].dataType.simpleString()))
