"""What the operators of this subpackage share: tables, stored intermediate results, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revloom.session import prepare, remove, run_folder

#: White space between words: space and 0x09 to 0x0D. A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that outlives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := f"{run_folder(spark)}/{uuid.uuid4().hex}")
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what store() wrote for these frames: nothing that is still to run may read them."""
    for df in frames:
        remove(df.sparkSession, df.stored_at)


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """df through a function from lists of columns to lists of columns, an Arrow batch at a time.

    make(batches) gets an iterator of {column: list} and yields {column: list}.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


AT_ONCE = 1_000_000


def _followed(parts):
    """(id, root) of all links (a, b) at once: labels go down the links and are halved until none changes."""
    import numpy as np
    import pandas as pd

    rows = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *parts])
    ids, at = np.unique(rows[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(ids))
    yield pd.DataFrame({"a": ids[other], "b": ids[label[other]]})


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(id, root) for each id in edges (a, b): root is the smallest id that links reach.

    Up to AT_ONCE links, which are counted first, are followed by one task; more by alternating large and small stars
    (Kiveris and others, 2014), to the same result. The smallest neighbours are found by sums that
    combine before the shuffle and are stored, so that the join back has two plain shuffles, of which adaptive
    execution splits the partition of a centre with very many links.
    """
    edges = store(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    if edges.count() <= at_once:
        out = store(edges.repartition(1).mapInPandas(_followed, "a long, b long").selectExpr("a AS id", "b AS root"))
        discard(edges)
        return out
    while True:
        both = edges.union(edges.selectExpr("b AS a", "a AS b"))
        low = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = store(both.join(low, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct())
        least = store(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").selectExpr("explode(array(struct(b AS a, m AS b), struct(a, m AS b))) AS e").select("e.*").where("a <> b").distinct()
        old, edges = edges, store(small)
        discard(old, low, large, least)
        # done when all are stars: each id has one link up, and none if links lead to it
        ends = edges.selectExpr("a AS id", "1 AS up").union(edges.selectExpr("b", "0"))
        if not ends.groupBy("id").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > least").count():
            return edges.selectExpr("a AS id", "b AS root")
