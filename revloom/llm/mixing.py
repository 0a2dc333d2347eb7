"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: every source gets its weight's share of all words, but at most three times its own; what that
leaves over is shared again by weight. The fixed point is min(3 * size, level * weight) with one level
for all, found by sorting the sources by the level at which they are full.

Sampling: each document of a source is expected target / source_size times. Documents are ordered by
size class, a salt and size; the expected copies are summed along that order, one random offset is added,
and a document is emitted once for each integer that its interval crosses. The order's position is the sum of
the counts of the (source, class, salt) buckets before, at most 64 * 256 for a source, and the rank within the bucket,
so that a source with a third of all rows is dealt out by salt.

Defined cases: a null text has size 0. Sources are ordered by code point, null last, and an empty source
is one by itself. A source without words has target 0. Rows that repeat are emitted independently,
with the ties between them broken either way. Reruns and other partitionings give the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revloom.llm.common import WORD, store

WEIGHTS, TIMES, SEED = (5, 2, 1), 3, "17"


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    out = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    return out.withColumns({"class": F.length(F.bin("size")), "salt": F.substring("key", 1, 2)})


def targets(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES, seed: str = SEED) -> DataFrame:
    """source, source_size, target and the random offset of each source: one row a source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    s = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * times)
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "taken_w": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "total": F.sum("source_size").over(everything), "total_w": F.sum("w").over(everything)})
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("total_w") - F.col("taken_w")))
    # the first source in that order which the level doesn't fill sets the level for itself and all after it
    s = s.withColumn("level", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    s = s.withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))))
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("\x00")), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0
    return s.select("source", "source_size", "target", offset.alias("offset"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for each row of docs (doc_id, source, text)."""
    thin = store(sizes(docs, seed))
    bucket = ["source", "class", "salt"]
    counts = thin.groupBy(*bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy(F.col("class").desc(), "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per = targets(thin, weights, times, seed)
    starts = store(starts.alias("b").join(per.alias("t"), F.expr("b.source <=> t.source")).select("b.source", "b.class", "b.salt", "start", "source_size", "target", "offset"))
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy(F.col("size").desc(), "key", "doc_id"))
    ranked = thin.withColumn("rank", rank)
    out = ranked.alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source AND d.class = s.class AND d.salt = s.salt"))
    out = out.selectExpr("doc_id", "size", "source_size", "target", "offset", "start + rank AS k", "CASE WHEN source_size > 0 THEN target / source_size ELSE 0D END AS r")
    return out.selectExpr("doc_id", "size", "source_size", "target", "CAST(floor(offset + r * k) - floor(offset + r * (k - 1)) AS BIGINT) AS copies").withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES, seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; rows that share a doc_id share its first count.

    A null text has size 0 and is taken as often as its source asks for any document; a null id is an id. No rows give none.
    """
    copies = mixed(docs, weights, times, seed).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    key, name = "id__", "copies__"
    while {key, name} & {c.lower() for c in docs.columns}:
        key, name = key + "_", name + "_"
    joined = docs.join(copies.withColumnsRenamed({"doc_id": key, "copies": name}), F.col("doc_id").eqNullSafe(F.col(key)))
    return joined.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH thin AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), ':17')) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM thin GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)] AS w, 3 * source_size AS cap FROM per),
c AS (SELECT *, coalesce(sum(cap) OVER full_, 0)::DOUBLE AS capped, coalesce(sum(w) OVER full_, 0)::DOUBLE AS taken_w, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS total_w
  FROM w WINDOW full_ AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - capped) / (total_w - taken_w), cap / w) AS level FROM c WHERE cap / w >= (total - capped) / (total_w - taken_w)),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target, ('0x' || substr(md5(concat(coalesce(source, chr(0)), ':17')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS offset_ FROM c, l),
r AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) DESC, substr(key, 1, 2), size DESC, key, doc_id) AS k FROM thin)
SELECT doc_id, size, source_size, target,
  ((floor(offset_ + rate * k) - floor(offset_ + rate * (k - 1)))::BIGINT * size)::BIGINT AS taken
FROM (SELECT r.*, t.source_size, t.target, t.offset_, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
"""
