"""Commits as streams: each document's state is kept between micro-batches, and each change is answered.

changes: doc_id, id, seq (order within a document), ops (JSON), at (milliseconds), base_rev. A document's changes
are committed in order of seq within a micro-batch, and micro-batches in their order. State is JSON, so that a
checkpoint outlives changes of this code. The twins commit a table of the same columns at once, to the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from revloom.kernels import fields, transform
from revloom.session import prepare

#: milliseconds for which a field document knows the ids of its changes
REMEMBER = 30 * 24 * 3600 * 1000
#: committed changes that a text or list document keeps: one made before them is answered with 'reload'
KEEP = 10_000
ROW = "doc_id long, id long, rev long, status string, ops string"


def _json(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


class FieldCommits:
    """Last-write-wins: the answer holds the rows that a sender is to take over."""

    load, start = fields.Document.load, fields.Document

    @staticmethod
    def commit(document: fields.Document, c: dict) -> tuple[int, str, str]:
        before = document.rev
        document.forget(c["at"] - REMEMBER)
        known = c["id"] in document.seen
        rows = document.commit({"id": c["id"], "ops": json.loads(c["ops"]), "created_at": c["at"], "base_rev": c["base_rev"]}, c["at"])
        return document.rev, "known" if known else "committed" if document.rev > before else "lost", _json(rows)


class FlatCommits:
    """Flat fields {key: {op, val, ts}}: the answer is what the change resolved to, for a known id once more."""

    load, start = fields.FlatDocument.load, fields.FlatDocument

    @staticmethod
    def commit(document: fields.FlatDocument, c: dict) -> tuple[int, str, str]:
        before, known = document.rev, c["id"] in document.done
        out = document.commit(c["id"], json.loads(c["ops"]))
        return document.rev, "known" if known else "committed" if document.rev > before else "lost", _json(out)


class Held(transform.Log):
    """A log whose older changes may be gone."""

    def dump(self) -> str:
        return _json(self.changes)

    @classmethod
    def load(cls, text: str) -> Held:
        return cls(json.loads(text))


class OpCommits:
    """Operational transform: the answer is the change as committed, without ops if nothing is left of it."""

    load, start = Held.load, Held

    @staticmethod
    def commit(log: Held, c: dict) -> tuple[int, str, str]:
        tip = log.changes[-1]["rev"] if log.changes else 0
        if c["id"] in log.known:
            return tip, "known", "[]"
        if c["base_rev"] > tip or log.changes and c["base_rev"] < log.changes[0]["rev"] - 1:
            return tip, "reload", "[]"
        rows = log.commit([{"id": c["id"], "base_rev": c["base_rev"], "ops": json.loads(c["ops"])}])
        log.trim(KEEP)
        return (rows[0]["rev"], "committed", _json(rows[0]["ops"])) if rows else (tip, "empty", "[]")


def _answers(kind, document, rows: pd.DataFrame) -> list[tuple]:
    return [(c["doc_id"], c["id"], *kind.commit(document, c)) for c in rows.sort_values("seq", kind="stable").to_dict("records")]


_NAMES = ["doc_id", "id", "rev", "status", "ops"]


def stream(changes: DataFrame, kind) -> DataFrame:
    """An answer for each change of a stream (append mode): doc_id, id, rev after it, status, ops."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        document = kind.load(state.get[0]) if state.exists else kind.start()
        # a document's rows of one micro-batch, whose size maxFilesPerTrigger and the like bound, have no order between batches
        yield pd.DataFrame(_answers(kind, document, pd.concat(batches, ignore_index=True)), columns=_NAMES)
        state.update((document.dump(),))

    prepare(changes.sparkSession)
    return changes.groupBy("doc_id").applyInPandasWithState(walk, ROW, "state string", "append", GroupStateTimeout.NoTimeout)


def table(changes: DataFrame, kind) -> DataFrame:
    """The same of a table, one document's rows at a time in Spark's order."""
    from revloom.plans.kernel_queries import groups_of

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in groups_of(batches, ["doc_id"]):
            yield pd.DataFrame(_answers(kind, kind.start(), rows), columns=_NAMES)

    prepare(changes.sparkSession)
    return changes.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInPandas(walk, ROW)


KINDS: dict[str, type] = {"fields": FieldCommits, "flat": FlatCommits, "ops": OpCommits}
