"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are the documents of quality 1 among the labels to learn from, the unlabelled are all documents that those labels don't
name; labels of quality 0 are never learned from, and labels not to learn from take no part at all. A text is described by FEATURES numbers about its bytes, words and
lines, computed once for every document and stored. A first classifier of positives against unlabelled
ranks all documents; over the histogram of all of them, the class prior is the least ratio of unlabelled to
positive shares above a threshold that at least half of the positives reach. The final classifier, logistic
on features, their squares and their products with the strongest, minimises the non-negative risk at that prior.

Both are fitted on at most SAMPLE positives and SAMPLE unlabelled rows, chosen by hashed ids.

Defined cases: a null text is described like an empty one. A document with several labels is positive if
at least half say so; null labels don't count. Without positives or unlabelled rows to learn from, every
score is 0.5. Documents that repeat get equal scores.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revloom.llm.common import map_rows, store

SAMPLE, BINS = 20_000, 1000
_KIND = np.zeros(256, np.uint8)  # 0 other marks, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 beyond ASCII, 7 usual marks, 8 ! and ?
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 1, 2, 3
_KIND[[0x20, 0x09]], _KIND[0x0A:0x0E], _KIND[128:] = 4, 5, 6
_KIND[[ord(c) for c in ".,;:'\"-()"]], _KIND[[ord(c) for c in "!?"]] = 7, 8
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LETTER, _ODD = re.compile(rb"[0-9A-Za-z\x80-\xff]"), re.compile(rb"[A-Za-z][^A-Za-z\x80-\xff'.,;:!?\")(-]+[A-Za-z]")


def describe(text: str | None) -> np.ndarray:
    """Numbers about a text, mostly shares, as float32."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9) / max(1, len(raw))
    words = _WORD.findall(raw)
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    runs = len({b" ".join(words[i : i + 3]) for i in range(len(words) - 2)})
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts[counts > 0] / max(1, len(raw))
    entropy = -float((shares * np.log2(shares)).sum())
    marks = sum(not _LETTER.search(w) for w in words) / n
    inside = sum(_ODD.search(w) is not None for w in words) / n
    long = max(map(len, words), default=0)
    capitals = sum(w.isupper() for w in words) / n
    first = sum(w[:1].isupper() for w in words) / n
    ends = sum(w[-1:] in b".!?" for w in words) / n
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    more = [same, np.log1p(len(words)), np.log1p(len(raw) / n), len(set(words)) / n, runs / max(1, len(words) - 2), len(set(lines)) / max(1, len(lines)), marks, inside, entropy, np.log1p(long), capitals, first, ends, np.log1p(n / max(1, len(lines)))]
    return np.concatenate([np.sqrt(kinds), more]).astype(np.float32)


FEATURES = 23


def _features(batches):
    for b in batches:
        yield {"doc_id": b["doc_id"], "x": [describe(t) for t in b["text"]]}


def _collect(rows: DataFrame, sample: int) -> np.ndarray:
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("x").toArrow()["x"]  # sample rows at most
    return np.array([v.as_py() for v in got], float).reshape(-1, FEATURES)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _adam(w: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w


class Linear:
    """A linear score of standardised features, their squares and a constant."""

    def __init__(self, x: np.ndarray):
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w = np.zeros(2 * FEATURES + 1)

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.concatenate([z, z * z / 4, np.ones((len(z), 1))], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.w


def separate(p: np.ndarray, u: np.ndarray) -> Linear:
    """Positives against unlabelled: a ranking by which the prior is estimated."""
    model = Linear(np.concatenate([p, u]))
    a, b = model.basis(p), model.basis(u)
    model.w = _adam(model.w, lambda w: -a.T @ (1 - _sigmoid(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + 1e-4 * w, 300, 0.05)
    return model


def prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from two histograms of a ranking, low to high: least ratio of the shares above a bin."""
    above_p, above_u = np.cumsum(positive[::-1]), np.cumsum(unlabelled[::-1])
    n, m = max(1, above_p[-1]), max(1, above_u[-1])
    enough = above_p >= max(1, 0.5 * n)
    return float(np.clip(np.min((above_u[enough] / m) / (above_p[enough] / n), initial=1.0), 0.05, 0.98))


def nonnegative(p: np.ndarray, u: np.ndarray, pi: float) -> Linear:
    """The minimiser of pi R+(p) + max(0, R-(u) - pi R-(p)) for the logistic loss (Kiryo and others, 2017)."""
    model = Linear(np.concatenate([p, u]))
    a, b = model.basis(p), model.basis(u)

    def gradient(w):
        sa, sb = _sigmoid(a @ w), _sigmoid(b @ w)
        negative = a.T @ sa / len(a), b.T @ sb / len(b)
        rest = np.logaddexp(0, b @ w).mean() - pi * np.logaddexp(0, a @ w).mean()
        if rest < 0:  # overfitting: go back up
            return -(negative[1] - pi * negative[0])
        return pi * (-a.T @ (1 - sa) / len(a)) + negative[1] - pi * negative[0] + 1e-4 * w

    model.w = _adam(model.w, gradient, 800, 0.03)
    return model


def quality(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text); train picks the rows of labels (doc_id, quality) to learn from."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = store(map_rows(docs.select("doc_id", "text"), _features, f"doc_id {id_type}, x array<float>"))
    known = labels.where("doc_id IS NOT NULL").where(train)
    good = known.where("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q >= 0.5").select("doc_id")
    positive, unlabelled = store(rows.join(good, "doc_id", "left_semi")), store(rows.join(known.select("doc_id").distinct(), "doc_id", "left_anti"))
    p, u = _collect(positive, sample), _collect(unlabelled, sample)
    if not len(p) or not len(u):
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    first = separate(p, u)

    def binned(batches):
        for b in batches:
            z = first(np.array(b["x"], float).reshape(-1, FEATURES))
            yield {"kind": b["kind"], "bin": np.minimum(BINS - 1, (_sigmoid(z) * BINS)).astype(int).tolist()}

    both = positive.selectExpr("x", "1 AS kind").union(unlabelled.selectExpr("x", "0 AS kind"))
    counts = np.zeros((2, BINS))
    for r in map_rows(both, binned, "kind int, bin int").groupBy("kind", "bin").count().collect():  # 2 * BINS rows at most
        counts[r["kind"], r["bin"]] = r["count"]
    model = nonnegative(p, u, prior(counts[1], counts[0]))

    def scored(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": _sigmoid(model(np.array(b["x"], float).reshape(-1, FEATURES))).tolist()}

    return map_rows(rows, scored, f"doc_id {id_type}, score double")
