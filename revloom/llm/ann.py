"""Approximate nearest neighbours by score-aware anisotropic quantisation and four-bit table scans.

Normalised vectors are cut into subspaces of two dimensions with 16 centres each. Codes and centres are
chosen to minimise the residual's squared length plus ETA - 1 times its squared part parallel to the
vector, which is what errs in inner products of near vectors: codes by coordinate descent, centres by a
least-squares solution over all subspaces at once, both on a bounded sample of SAMPLE vectors. Every
vector is encoded. A query block scans a block of codes with tables of inner products, two codes to a
lookup; the best RERANK of each block are ranked again by exact cosines in double precision, and so is every other
vector whose score, with a bound on its error, reaches the last of those that count. So a block loses none of a query's
nearest, however many vectors share their codes. For the bound each vector x keeps its residual's part e along x and
length p across it: a query with cosine s to x scores s (1 - e) - p sqrt(1 - s^2) at least.

Vectors of one direction (positive multiples) are collapsed before the search and expanded after it, so that a
direction which a third of all rows share is scanned once; its TOP + 1 smallest ids are all that can be among a query's nearest.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
those of another length than the most frequent. Ties go to the smaller vec_id. Rows that repeat a vec_id with the same vector are
one candidate. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revloom.llm.common import map_rows, store

SAMPLE, CENTRES, ETA, RERANK, ROWS, QUERIES, TOP = 8192, 16, 2.6, 160, 8192, 4096, 5
SLACK = 1e-4  # for rounding: scores are sums in single precision


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Codebooks of 16 centres for each pair of dimensions (an odd last dimension is padded with a zero)."""

    def __init__(self, x: np.ndarray, rounds: int = 3):
        x = self.cut(unit(x))
        rng = np.random.default_rng(7)
        n, m, _ = x.shape
        c = x[rng.choice(n, CENTRES, replace=n < CENTRES)].transpose(1, 0, 2) + rng.normal(0, 1e-6, (m, CENTRES, 2))
        for _ in range(12):  # plain k-means first
            code = ((x.transpose(1, 0, 2)[:, :, None] - c[:, None]) ** 2).sum(-1).argmin(-1)
            for j in range(m):
                count = np.bincount(code[j], minlength=CENTRES)[:, None]
                total = np.stack([np.bincount(code[j], x[:, j, d], CENTRES) for d in (0, 1)], 1)
                c[j] = np.where(count > 0, total / np.maximum(count, 1), c[j])
        self.c = c
        for _ in range(rounds):
            self._solve(x, self._codes(x))

    @staticmethod
    def cut(x: np.ndarray) -> np.ndarray:
        if x.shape[1] % 2:
            x = np.pad(x, ((0, 0), (0, 1)))
        return x.reshape(len(x), -1, 2)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        m = x.shape[1]
        code = np.stack([((x[:, j, None] - self.c[j]) ** 2).sum(-1).argmin(-1) for j in range(m)], 1)
        along = np.stack([((x[:, j] - self.c[j][code[:, j]]) * x[:, j]).sum(-1) for j in range(m)], 1)
        total = along.sum(1)
        for _ in range(2):
            for j in range(m):
                r = x[:, j, None] - self.c[j]
                part = (r * x[:, j, None]).sum(-1)
                rest = total - along[:, j]
                code[:, j] = ((r**2).sum(-1) + (ETA - 1) * (rest[:, None] + part) ** 2).argmin(-1)
                along[:, j] = np.take_along_axis(part, code[:, j, None], 1)[:, 0]
                total = rest + along[:, j]
        return code

    def _solve(self, x: np.ndarray, code: np.ndarray) -> None:
        n, m, _ = x.shape
        v = np.zeros((n, m, CENTRES, 2))
        v[np.arange(n)[:, None], np.arange(m)[None], code] = x
        v = v.reshape(n, -1)
        count = np.stack([np.bincount(code[:, j], minlength=CENTRES) for j in range(m)]).repeat(2, 1).reshape(-1)
        a = np.diag(count + 1e-3) + (ETA - 1) * (v.T @ v)
        b = ETA * v.sum(0) + 1e-3 * self.c.reshape(-1)  # S'Wx = S'x + (eta - 1) S'x |x|^2, and x is a unit vector
        self.c = np.linalg.solve(a, b).reshape(self.c.shape)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two codes to a byte; the residual's part along the vector and its length across."""
        x = self.cut(unit(x))
        code = self._codes(x)
        r = x - self.c[np.arange(x.shape[1]), code]
        along = (r * x).sum((1, 2))
        across = np.sqrt(((r - along[:, None, None] * x) ** 2).sum((1, 2)))
        code = code.astype(np.uint8)
        if code.shape[1] % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return code[:, ::2] << 4 | code[:, 1::2], along, across

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, byte of code, value) -> part of the inner product."""
        t = np.einsum("qmd,mcd->qmc", self.cut(unit(q)), self.c).astype(np.float32)
        if t.shape[1] % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)


def needed(s: float, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """The least score that a vector of cosine s or more can have."""
    any_way = s - np.hypot(along, across)
    if s < 0:
        return any_way - SLACK
    # grows with s from 0 on where along < 1
    return np.maximum(any_way, np.where(along < 1, s * (1 - along) - across * np.sqrt(max(0.0, 1 - s * s)), any_way)) - SLACK


def usable(vectors: DataFrame) -> DataFrame:
    ok = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0 AND forall(v, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity')) AND exists(v, e -> e <> 0)")
    length = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    # over the largest component, taken once a row: positive multiples of a vector become equal
    return ok.where(F.size("v") == (length.n if length else 0)).selectExpr("vec_id", "transform(array(array_max(transform(v, x -> abs(x)))), m -> transform(v, e -> e / m))[0] AS v")


def nearest(vectors: DataFrame, every: int = 50, top: int = TOP, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest of each vector whose vec_id is divisible by `every`."""
    schema = "query_id long, rank int, vec_id long, score double"
    rows = store(usable(vectors))
    spark = rows.sparkSession
    first = Window.partitionBy("v").orderBy("vec_id")
    # a limit by group, which Spark applies before its shuffle too
    ids = rows.withColumn("r", F.dense_rank().over(first)).where(f"r <= {top + 1}").groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = store(ids.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    if not n:
        return spark.createDataFrame([], schema)
    got = classes.select("cls", "v").orderBy(F.xxhash64("v"), "cls").limit(SAMPLE).toArrow()["v"]
    quantiser = spark.sparkContext.broadcast(Quantiser(np.array([v.as_py() for v in got])))
    asked = store(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct().join(classes.select("v", "cls"), "v").select("query_id", "cls"))
    wanted = classes.join(asked.select("cls").distinct(), "cls", "left_semi").select("cls", "v")
    blocks, sets = -(-n // ROWS), -(-max(1, wanted.count()) // QUERIES)

    def encoded(batches):
        for b in batches:
            code, along, across = quantiser.value.encode(np.array(b["v"]))
            yield b | {"code": [c.tobytes() for c in code], "along": along, "across": across}

    base = map_rows(classes, encoded, "cls long, ids array<long>, v array<double>, code binary, along double, across double")
    base = base.withColumns({"block": F.pmod(F.xxhash64("cls"), F.lit(blocks)), "set": F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))})
    some = wanted.withColumns({"set": F.pmod(F.xxhash64("cls"), F.lit(sets)).cast("int"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})

    def scan(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            code = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1).T.astype(np.intp)
            exact, asked_v = np.stack(x["v"].to_numpy()), np.stack(q["v"].to_numpy())
            along, across = x["along"].to_numpy(), x["across"].to_numpy()
            norm, lowest, keep = np.linalg.norm(exact, axis=1), np.array([i[0] for i in x["ids"]]), min(len(x), rerank)
            for at in range(0, len(q), 64):
                for cls, v, t in zip(q["cls"][at : at + 64], asked_v[at : at + 64], quantiser.value.tables(asked_v[at : at + 64])):
                    near = sum(t[j][code[j]] for j in range(len(code)))
                    best = np.argpartition(-near, keep - 1)[:keep]
                    score = (exact[best] @ v) / (norm[best] * np.sqrt(v @ v))
                    if keep < len(x):
                        best = np.union1d(best, np.flatnonzero(near >= needed(np.sort(score)[-min(top + 1, keep)], along, across)))
                        score = ((exact[best] if len(best) < len(x) // 4 else exact) @ v) / np.sqrt(v @ v)
                        score = (score if len(score) == len(best) else score[best]) / norm[best]
                    for k in np.lexsort((lowest[best], -score))[: top + 1]:
                        out.append((cls, x["ids"].iloc[best[k]], float(score[k])))
        return pd.DataFrame(out, columns=["cls", "ids", "score"])

    found = some.groupBy("block", "set").cogroup(base.groupBy("block", "set")).applyInPandas(scan, "cls long, ids array<long>, score double")
    found = found.select("cls", F.explode("ids").alias("vec_id"), "score")
    ranked = Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(ranked)).where(f"r <= {top + 1}").drop("r")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(found, "cls").where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked)).where(f"rank <= {top}")
    return out.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")
