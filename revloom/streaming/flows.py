"""Streaming forms of change-log operators, all on built-in operators with state in the JVM.

changes: a streaming frame with doc_id, id, rev, path, op, value, ts (milliseconds), client_id, at (event time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(changes: DataFrame, late: str = "30 days") -> DataFrame:
    """Each (doc_id, id) once: re-sent changes within the retention of ids are dropped."""
    return changes.withWatermark("at", late).dropDuplicatesWithinWatermark(["doc_id", "id"])


def fields(changes: DataFrame) -> DataFrame:
    """The winning set or remove of each field so far (update or complete mode); ties go to the later rev."""
    won = changes.where("op IN ('replace', 'remove')").groupBy("doc_id", "path").agg(F.max_by(F.struct("op", "value", "ts"), F.struct("ts", "rev")).alias("w"))
    return won.select("doc_id", "path", "w.op", "w.value", "w.ts")


def deltas(changes: DataFrame) -> DataFrame:
    """Sums, maxima and minima of the in-place ops of each field (update or complete mode)."""
    return changes.where("substr(op, 1, 1) = '@'").groupBy("doc_id", "path").agg(
        *(f(F.when(F.col("op") == op, F.col("value"))).alias(name) for op, f, name in (("@inc", F.sum, "inc"), ("@max", F.max, "hi"), ("@min", F.min, "lo")))
    )


def versions(changes: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A version for each session of a document, once the watermark is past it (append mode)."""
    by = changes.withWatermark("at", late).groupBy("doc_id", F.session_window("at", gap).alias("session"))
    return by.agg(F.min("rev").alias("start_rev"), F.max("rev").alias("end_rev"), F.count("*").alias("n"))


def broadcast(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(client_id, doc_id, rev, id) to send: a stream joined with a static table of (client_id, doc_id)."""
    subs = subscriptions.selectExpr("client_id AS receiver", "doc_id")
    return changes.join(subs, "doc_id").where("receiver <> client_id").selectExpr("receiver AS client_id", "doc_id", "rev", "id")


def presence(states: DataFrame) -> DataFrame:
    """The last state (client_id, doc_id, seq, state; null: gone) of each peer that is there (complete mode)."""
    last = states.groupBy("client_id", "doc_id").agg(F.max_by(F.struct("state"), "seq").alias("s"))
    return last.where("s.state IS NOT NULL").select("client_id", "doc_id", "s.state")
