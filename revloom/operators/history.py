"""States of documents as of a revision, from snapshots and the tail behind them.

changes: doc_id, rev, path, op ('replace' or 'remove'), value. A snapshot is kept every `every` revisions, as intervals: a
path's value is stored once for all snapshots that it stands in. A state then reads the intervals that hold its snapshot and
at most `every` - 1 revisions of its log, however long that is. Store snapshots() partitioned by document, and it is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVERY = 25


def snapshots(changes: DataFrame, every: int = EVERY) -> DataFrame:
    """doc_id, path, op, value, first, last: the last write of a path before each snapshot, for the snapshots first to last."""
    at = (F.ceil(F.col("rev") / every) * every).cast("long")
    won = changes.groupBy("doc_id", "path", at.alias("first")).agg(F.max_by(F.struct("op", "value"), "rev").alias("w"))
    after = F.lead("first").over(Window.partitionBy("doc_id", "path").orderBy("first"))
    return won.select("doc_id", "path", "w.op", "w.value", "first", F.coalesce(after - every, F.lit((1 << 62) - 1)).alias("last"))


def states(changes: DataFrame, snaps: DataFrame, asked: DataFrame, every: int = EVERY) -> DataFrame:
    """doc_id, at, path, value for each (doc_id, at) in asked: the document's paths as of revision `at`."""
    asked = asked.select("doc_id", "at", (F.floor(F.col("at") / every) * every).cast("long").alias("base"))
    old = asked.join(snaps, "doc_id").where("first <= base AND base <= last").select("doc_id", "at", "path", F.col("base").alias("rev"), "op", "value")
    tail = asked.join(changes, "doc_id").where("rev > base AND rev <= at").select("doc_id", "at", "path", "rev", "op", "value")
    # a write of the tail is always later than the snapshot
    won = old.withColumn("late", F.lit(0)).union(tail.withColumn("late", F.lit(1))).groupBy("doc_id", "at", "path").agg(F.max_by(F.struct("op", "value"), F.struct("late", "rev")).alias("w"))
    return won.where("w.op <> 'remove'").select("doc_id", "at", "path", "w.value")


def tip(changes: DataFrame) -> DataFrame:
    """(doc_id, at): each document's last revision, to ask states() for what it holds now."""
    return changes.groupBy("doc_id").agg(F.max("rev").alias("at"))


def compact(changes: DataFrame, every: int = 200) -> DataFrame:
    """The log with what stands before each document's last multiple of `every` revisions folded: doc_id, kind, rev, path, op, value.

    Rows of kind 'snapshot' are the last write of each path up to that revision, removes left out; those of kind 'op'
    are the tail behind it, as written. A document without so many revisions keeps its log.
    """
    base = (F.floor(F.max("rev").over(Window.partitionBy("doc_id")) / every) * every).cast("long")
    rows = changes.select("doc_id", "rev", "path", "op", "value", base.alias("base"))
    old = rows.where("rev <= base").groupBy("doc_id", "base", "path").agg(F.max_by(F.struct("op", "value"), "rev").alias("w"))
    snap = old.where("w.op <> 'remove'").select("doc_id", F.lit("snapshot").alias("kind"), F.col("base").alias("rev"), "path", "w.op", "w.value")
    return snap.union(rows.where("rev > base").select("doc_id", F.lit("op"), "rev", "path", "op", "value"))


def branch_seeds(changes: DataFrame, branches: DataFrame, every: int = EVERY) -> DataFrame:
    """(branch_id, rev, ops) for each (doc_id, at) in branches: a first change that puts the whole state as of `at`, its paths in order.

    A document that holds nothing then seeds an empty object. One row holds one document's fields.
    """
    held = states(changes, snapshots(changes, every), branches, every)
    state = held.groupBy("doc_id", "at").agg(F.array_sort(F.collect_list(F.struct(F.substring("path", 2, 1 << 30).alias("k"), "value"))).alias("fields"))
    text = F.coalesce(F.to_json(F.map_from_entries("fields")), F.lit("{}"))
    ops = F.concat(F.lit('[{"op":"replace","path":"","value":'), text, F.lit("}]"))
    return branches.select("doc_id", "at").distinct().join(state, ["doc_id", "at"], "left").select(F.concat(F.lit("branch-"), F.col("doc_id").cast("string")).alias("branch_id"), F.lit(1).alias("rev"), ops.alias("ops"))
