"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of 2 to 4 characters within its lower-case words, a word's borders counting as a space.
Each is hashed to a row of an embedding table; their average goes through a linear layer and a softmax. Training is
plain stochastic gradient descent in numpy on a sample bounded by ``per_lang``, ``most_texts`` and ``longest``; a temperature fitted on a part of the sample that was
kept back calibrates the scores, and the rejection threshold is the score that all but ``reject_rate`` of that part's
right answers reach.

Nulls: a null text, or one without a letter, is ``und`` with score 0 and is rejected. A null lang or text is never
learned from; a null doc_id is neither learned from nor held out. Repeated rows each get the same prediction; a tie goes to
the language that sorts first. An empty table, or one without labels, gives ``und`` for every row. Input columns other
than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokenizing import release

PREDICTED = "lang_pred string, score double, rejected boolean"
_ORDERS = (2, 3, 4)
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-case text, other characters than letters as a space, with a space at either end."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_LETTER[x], x, np.uint32(32))


def _subwords(x: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the table row of the subword at each place, and whether there is one."""
    inner = x != 32
    for n in _ORDERS:
        size = len(x) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n * 0x61C88647 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ x[k : k + size]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        there = inner[:size] | inner[1:] if n == 2 else np.logical_and.reduce([inner[k : k + size] for k in range(1, n - 1)])
        yield (h & np.uint32((1 << bits) - 1)).astype(np.int32), there


@dataclass
class Model:
    langs: list[str]
    bits: int
    #: a subword's embedding; with few languages already times the output layer, which then is the unit matrix
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score and rejection of each text."""
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        sums, counts = np.zeros((n, self.table.shape[1])), np.zeros(n)
        at = 0
        while at < n:
            end, held, parts = at, 0, []
            while end < n and held < 500_000:  # so many characters at once; a longer text alone
                parts.append(_letters(texts[end] or ""))
                held += len(parts[-1])
                end += 1
            starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
            x = np.concatenate(parts)
            for rows, there in _subwords(x, self.bits):
                where = np.flatnonzero(there)
                if not len(where):
                    continue
                doc = np.searchsorted(starts, where, side="right") - 1
                edge = np.flatnonzero(np.diff(doc, prepend=-1))
                sums[at + doc[edge]] += np.add.reduceat(self.table[rows[where]], edge, axis=0)
                counts[at + doc[edge]] += np.diff(edge, append=len(where))
            at = end
        p = _softmax((sums / np.maximum(counts, 1)[:, None] @ self.layer + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(counts > 0, p[np.arange(n), best], 0.0)
        langs = [self.langs[b] if c else "und" for b, c in zip(best.tolist(), counts.tolist())]
        return langs, score, (counts == 0) | (score < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    found = [rows[there] for rows, there in _subwords(_letters(text), bits)]
    rows, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0))
    return rows, (counts / max(counts.sum(), 1)).astype(np.float32)


def fit(samples: list[tuple[str, str]], bits: int = 16, width: int = 16, epochs: int = 4, rate: float = 0.5, reject_rate: float = 0.001, seed: int = 7) -> Model:
    """A model from (text, lang) pairs. Each text is learned from whole, and once more as a random short stretch of
    it, so that short texts are scored as well as long ones. Steps are bounded by their norms and cannot run away."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return Model([], bits, np.zeros((1, 1), np.float32), np.zeros((1, 1)), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    kept_back = {int(i) for i in order[: len(samples) // 5]} if len(samples) >= 50 else set()
    number = {x: i for i, x in enumerate(langs)}
    learn, check = [], []
    for i, (text, lang) in enumerate(samples):
        start, length = int(rng.integers(0, max(1, len(text) - 20))), int(rng.integers(12, 160))
        for part in (text, text[start : start + length]):
            rows, weights = _bag(part, bits)
            if len(rows):
                (check if i in kept_back else learn).append((rows, weights, number[lang]))
    table = rng.normal(0, 1 / width, (1 << bits, width)).astype(np.float32)
    layer, bias = np.zeros((width, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps = max(1, epochs * len(learn))
    done = 0
    for _ in range(epochs):
        for j in rng.permutation(len(learn)):
            rows, weights, lang = learn[j]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = weights @ table[rows]
            error = _softmax(hidden @ layer + bias)
            error[lang] -= 1
            back = layer @ error
            back /= max(1.0, float(np.linalg.norm(back)))
            layer -= lr * np.outer(hidden / max(1.0, float(np.linalg.norm(hidden))), error)
            bias -= 0.1 * lr * error
            # the average's gradient, shared out by weight and scaled so that long texts teach as much as short ones
            table[rows] -= (lr * weights * min(len(rows), 50))[:, None] * back
    if not (np.isfinite(table).all() and np.isfinite(layer).all()):
        raise ArithmeticError("training did not converge")
    final, out = ((table @ layer).astype(np.float32), np.eye(len(langs))) if len(langs) <= width else (table, layer.astype(float))
    temperature, threshold = 1.0, 0.0
    if check := check or learn:
        logits = np.array([w @ final[r] @ out + bias for r, w, _ in check])
        truth = np.array([y for *_, y in check])
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.2, 8, 60), key=loss))
        p = _softmax(logits / temperature)
        right = p.argmax(axis=1) == truth
        if right.any():
            threshold = min(0.5, float(np.quantile(p.max(axis=1)[right], reject_rate)))
    return Model(langs, bits, final, out, bias.astype(float), temperature, threshold)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, per_lang: int = 1000, most_texts: int = 24_000, longest: int = 4000) -> list[tuple[str, str]]:
    """The texts to learn from: of each language about ``per_lang`` different ones, chosen by a hash, less where that
    makes more than ``most_texts`` (but 16 at least); of each a stretch of ``longest`` characters at most, from a place
    chosen by the hash. So the driver gets some 100 MB at most, up to 1500 languages; every language is learned."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return []
    each = max(16, min(per_lang, most_texts // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * each / r["count"])) for r in counts], "lang string, share double")
    h = F.xxhash64("doc_id", "text", F.lit(11))
    rows = labelled.select("text", "lang", h.alias("h")).join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - longest, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("lang", "h", F.substring("text", start, F.lit(longest)).alias("text")).dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = rows.withColumn("place", place).where(F.col("place") <= each).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["place"]))]


def train(docs: DataFrame, per_lang: int = 1000) -> Model:
    return fit(sample(docs, per_lang))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with PREDICTED's columns (which replace any of those names), for every whole text."""
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size set by bits, width and the number of languages

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        model = shared.value
        for frame in frames:
            langs, score, rejected = model.predict(frame["text"].tolist())
            yield frame.assign(lang_pred=langs, score=score, rejected=rejected)

    return docs.mapInPandas(run, f"{docs._jdf.schema().toDDL()}, {PREDICTED}")
