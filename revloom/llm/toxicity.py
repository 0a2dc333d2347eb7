"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The n-grams are of 4 to 6 bytes of the lower-cased text, white space as one space, hashed into 2^20
buckets and taken as present or absent. Log-count ratios come from the labelled documents; the FEATURES
buckets with the largest log-likelihood ratio keep theirs, and a logistic regression with L2 penalty and
toxic rows weighing POSITIVE is fitted on features scaled by them. The model is fitted on at most SAMPLE labelled rows, chosen by the hash
of their ids; every whole text is scored.

Defined cases: a null text scores as an empty one, by the intercept. A document with several labels is
toxic if at least half of them say so; null labels don't count. Labels of documents that aren't there
don't matter. Without labels of both classes, every score is the smoothed share of toxic labels.
Documents that repeat get equal scores.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revloom.llm.common import map_rows, store

SAMPLE, FEATURES, BITS, GRAMS, PENALTY, POSITIVE = 20_000, 1000, 20, (4, 5, 6), 1e-3, 3.0
_GAP = re.compile(rb"[\x20\x09-\x0D]+")


def ngrams(text: str | None, piece: int = 1 << 20) -> list[np.ndarray]:
    """The buckets of the text's n-grams, with repetitions; long texts in overlapping pieces."""
    raw = _GAP.sub(b" ", b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" ")
    out = []
    for at in range(0, max(1, len(raw)), piece):
        x = np.frombuffer(raw[at : at + piece + GRAMS[-1] - 1], np.uint8).astype(np.uint32)
        h = np.zeros(len(x), np.uint32)
        with np.errstate(over="ignore"):
            for n in range(1, GRAMS[-1] + 1):
                if len(x) < n:
                    break
                h = h[: len(x) - n + 1] * np.uint32(0x01000193) + (x[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
                if n >= GRAMS[0]:
                    g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
                    out.append(g >> np.uint32(32 - BITS))
    return out


def present(text: str | None) -> np.ndarray:
    g = ngrams(text)
    return np.unique(np.concatenate(g)) if g else np.zeros(0, np.uint32)


def labelled(docs: DataFrame, labels: DataFrame, column: str, train: Column, sample: int) -> DataFrame:
    """doc_id, text, y of at most `sample` labelled documents: labels.column by majority, in the order of hashed ids."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(train).groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("y"))
    chosen = y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return store(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # sample rows at most


def _counts(batches):
    n = np.zeros((2, 1 << BITS), np.int64)
    docs = np.zeros(2, np.int64)
    for b in batches:
        for text, y in zip(b["text"], b["y"]):
            n[y, present(text)] += 1
            docs[y] += 1
    at = np.flatnonzero(n.any(axis=0))
    yield {"bucket": [-1, *at.tolist()], "neg": [int(docs[0]), *n[0, at].tolist()], "pos": [int(docs[1]), *n[1, at].tolist()]}


def logistic(row: np.ndarray, col: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float = PENALTY, positive: float = POSITIVE) -> tuple[np.ndarray, float]:
    """(weights, intercept) of rows with features (row, col) of value ratio[col]: full-batch Adam on the logistic loss."""
    scaled, n = ratio[col], len(y)
    w, b = np.zeros(len(ratio)), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 301):
        z = np.bincount(row, scaled * w[col], n) + b
        g = np.where(y == 1, positive, 1.0) * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        gw, gb = np.bincount(col, g[row] * scaled, len(w)) + penalty * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        f, s = 1 - 0.9**step, 1 - 0.99**step
        w, b = w - 0.03 * (m / f) / (np.sqrt(v / s) + 1e-8), b - 0.03 * (mb / f) / (np.sqrt(vb / s) + 1e-8)
    return w, float(b)


def fit(train: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, float]:
    """(a weight for each bucket, intercept) from train (text, y)."""
    counts = store(map_rows(train.select("text", "y"), _counts, "bucket int, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    weight = np.zeros(1 << BITS)
    n0, n1 = counts.where("bucket = -1").select(F.coalesce(F.sum("neg"), F.lit(0)), F.coalesce(F.sum("pos"), F.lit(0))).first()
    if not n0 or not n1:
        return weight, float(np.log((n1 + 1) / (n0 + 1)))
    shares = {"p": f"(pos + 1) / ({n1} + 2)", "q": f"(neg + 1) / ({n0} + 2)", "both": f"(pos + neg + 1) / ({n0 + n1} + 2)"}
    ranked = counts.where("bucket >= 0").selectExpr("bucket", "neg", "pos", *[f"{e} AS {c}" for c, e in shares.items()])
    gain = " + ".join(f"{k} * ln({r} / both) + ({n} - {k}) * ln((1 - {r}) / (1 - both))" for k, n, r in (("pos", n1, "p"), ("neg", n0, "q")))
    # the gain is ranked where the counts are; only the features themselves reach the driver
    best = ranked.selectExpr("bucket", "ln(p / q) AS ratio", f"round({gain}, 9) AS gain").orderBy(F.desc("gain"), "bucket").limit(features).select("bucket", "ratio").toArrow()
    buckets, ratio = best["bucket"].to_numpy(), best["ratio"].to_numpy()
    column = np.full(1 << BITS, -1, np.int32)
    column[buckets] = np.arange(len(buckets))

    def chosen(batches):
        for b in batches:
            yield {"y": b["y"], "x": [(z := column[present(t)])[z >= 0] for t in b["text"]]}

    got = map_rows(train.select("text", "y"), chosen, "y int, x array<int>").toArrow().combine_chunks()  # SAMPLE rows of `features` numbers at most
    hits = got["x"].combine_chunks()
    row = np.repeat(np.arange(len(hits)), np.diff(hits.offsets.to_numpy()))
    w, b = logistic(row, hits.flatten().to_numpy(), ratio, got["y"].to_numpy().astype(float))
    weight[buckets] = w * ratio
    return weight, b


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text)."""
    weight, b = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32)), model[1]

    def make(batches):
        w = weight.value
        for rows in batches:
            out = []
            for text in rows["text"]:
                hits = [h for g in ngrams(text) if len(h := g[w[g] != 0])]
                z = b + (float(w[np.unique(np.concatenate(hits))].astype(float).sum()) if hits else 0.0)
                out.append(1 / (1 + np.exp(-min(35.0, max(-35.0, z)))))
            yield {"doc_id": rows["doc_id"], "score": out}

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, features: int = FEATURES) -> DataFrame:
    """doc_id, score for each row of docs; train picks the rows of labels (doc_id, toxic) to learn from."""
    return score(docs, fit(labelled(docs, labels, "toxic", train, sample), features))


def reject(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.7) -> DataFrame:
    """docs without those that score at least the threshold."""
    model = fit(labelled(docs, labels, "toxic", train, SAMPLE))
    weight, b = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32)), model[1]
    level = float(np.log(threshold / (1 - threshold))) - b
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def toxic(texts):
        import pandas as pd

        w = weight.value
        out = []
        for text in texts:
            hits = [h for g in ngrams(text) if len(h := g[w[g] != 0])]
            out.append(bool(hits) and float(w[np.unique(np.concatenate(hits))].astype(float).sum()) >= level or (not hits and level <= 0))
        return pd.Series(out, dtype=bool)

    return docs.where(~toxic("text"))
