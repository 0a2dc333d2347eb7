"""Queries whose rows need a document's ops in order: small kernels, one group of a document's rows at a time.

A document is the unit of order, so each is one group; field resolution shards further by the first path segment,
as no rule reaches across it but a write at the root.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from revloom.kernels import delta, fields, lz, ordering, patch, splitting, textlog, transform
from revloom.operators import history
from revloom.session import prepare
from revloom.sources.logs import spark_statement, with_logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def groups_of(batches, by: list[str]):
    """(key, rows) of each group in a stream of frames ordered by key: one group is held at a time, however many frames it spans."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        keys = pdf[by].to_numpy(object)
        if held:
            keys = np.concatenate([held[-1][by].iloc[-1:].to_numpy(object), keys])
        new = (keys[1:] != keys[:-1]).any(axis=1)
        cut = [*(np.flatnonzero(new) + (0 if held else 1)).tolist(), len(pdf)]
        at = 0
        for end in cut:
            if end > at:
                held.append(pdf.iloc[at:end])
            if end < len(pdf) and held:
                yield tuple(held[0][c].iat[0] for c in by), held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            at = end
    if held:
        yield tuple(held[0][c].iat[0] for c in by), held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def per_group(name: str, sql: str, by: list[str], schema: str, make, oracle: str | None = None, queries: dict = QUERIES, oracles: dict = ORACLES) -> None:
    """Rows of a statement, dealt by key and sorted by Spark, each key's in the order of its seq through make(key, rows) -> list of tuples. It goes into `queries` and `oracles`."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = prepare(spark).sql(spark_statement(sql, sf_dir))

        def walk(batches):
            out: list[tuple] = []
            for key, pdf in groups_of(batches, by):
                out += make(key, pdf)
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

        return rows.repartition(*by).sortWithinPartitions(*by, "seq").mapInPandas(walk, schema)

    queries[name] = run
    if oracle:
        oracles[name] = with_logs(oracle, "duckdb")


def _ops(pdf: pd.DataFrame) -> list[dict]:
    return [{"op": o, "path": p, "ts": int(t)} | ({} if o == "remove" else {"value": int(v)}) for o, p, v, t in zip(pdf["op"], pdf["path"], pdf["value"], pdf["ts"])]


per_group(
    "lww_tree_fields",
    "SELECT *, split(path, '/')[1] AS shard FROM treelog",
    ["doc_id", "shard"],
    "doc_id long, path string, op string, value long, ts long",
    lambda key, pdf: [(key[0], p, r["op"], r.get("value"), r["ts"]) for p, r in fields.commit_all(_ops(pdf)).items()],
)


def _lww_commit(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Each op a change of its own, every ninth of them sent twice."""
    document = fields.Document()
    for i, op, now in zip(pdf["id"], _ops(pdf), pdf["created_at"]):
        for _ in range(2 if i % 9 == 0 else 1):
            document.commit({"id": int(i), "ops": [op], "base_rev": document.rev}, int(now))
    return [(key[0], r["path"], r["op"], r.get("value"), r["ts"], r["rev"], document.rev) for r in document.table.rows()]


per_group(
    "lww_commit",
    "SELECT * FROM setlog",
    ["doc_id"],
    "doc_id long, path string, op string, value long, ts long, rev long, tip long",
    _lww_commit,
    """a AS (SELECT *, ts >= coalesce(max(ts) OVER (PARTITION BY doc_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) AS won FROM setlog),
  b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rev FROM a WHERE won)
;
SELECT doc_id, path, op, CASE WHEN op = 'replace' THEN value END AS value, ts, rev, (SELECT count(*) FROM b t WHERE t.doc_id = b.doc_id) AS tip FROM b
      WHERE NOT EXISTS (SELECT 1 FROM b l WHERE l.doc_id = b.doc_id AND l.path = b.path AND l.rev > b.rev)""",
)


def _flat(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    state: dict = {}
    for o, p, v in zip(pdf["op"], pdf["path"], pdf["value"]):
        state = patch.apply(state, [{"op": o, "path": p, "value": int(v)}], strict=True)
    return [(key[0], f"/{k}", v) for k, v in state.items()]


per_group(
    "replay_flat",
    "SELECT * FROM setlog",
    ["doc_id"],
    "doc_id long, path string, value long",
    _flat,
    "SELECT doc_id, path, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY seq DESC) AS r FROM setlog) x WHERE r = 1 AND op = 'replace'",
)


def _round_trip(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    ops = [{"op": o, "path": p} | ({} if o == "remove" else {"value": int(v)}) for o, p, v in zip(pdf["op"], pdf["path"], pdf["value"])]
    done = patch.apply({}, ops)
    undo = patch.invert({}, ops)
    return [(key[0], len(ops), len(patch.compose(ops)), patch.same(patch.apply(done, undo), {}), patch.same(patch.apply({}, patch.compose(ops)), done))]


per_group(
    "invert_and_compose",
    "SELECT * FROM oplog",
    ["doc_id"],
    "doc_id long, n_ops long, n_composed long, undone boolean, composed_alike boolean",
    _round_trip,
)


def _text(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    state: dict = {}
    for text in pdf["text"]:
        now = patch.get(state, "/body")
        at = 0 if now is patch.MISSING else sum(map(delta.length, now)) - 1
        state = patch.apply(state, [{"op": "@txt", "path": "/body", "value": [*([{"retain": at}] if at else []), {"insert": (text or "") + "\n"}]}], strict=True)
    return [(key[0], len(pdf), delta.plain(state["body"]))]


per_group(
    "text_replay",
    "SELECT * FROM textlog",
    ["doc_id"],
    "doc_id long, turns long, body string",
    _text,
    "SELECT doc_id, count(*) AS turns, string_agg(coalesce(text, ''), chr(10) ORDER BY seq) || chr(10) || chr(10) AS body FROM textlog GROUP BY doc_id",
)

per_group(
    "order_keys",
    "SELECT doc_id, rev AS seq, id FROM changelog",
    ["doc_id"],
    "doc_id long, pos long, key string",
    lambda key, pdf: [(key[0], i, k) for i, k in enumerate(ordering.spread("a0", "a1", len(pdf)), 1)],
)
per_group(
    "healed_orders",
    "SELECT doc_id, rev AS seq, id, concat('a', CAST(k % 10 AS STRING)) AS ord FROM changelog",
    ["doc_id"],
    "doc_id long, id string, ord string",
    lambda key, pdf: [(key[0], k, o) for k, o in ordering.heal([(str(i), o) for i, o in zip(pdf["id"], pdf["ord"])]).items()],
)


def _micro(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    kinds = {"replace": "=", "remove": "!", "@inc": "+", "@max": "^", "@min": "="}
    rows: dict[str, dict] = {}
    for o, p, v, t in zip(pdf["op"], pdf["path"], pdf["value"], pdf["ts"]):
        rows[p[1:]] = fields.flat_merge(rows.get(p[1:]), {"op": kinds[o], "val": None if o == "remove" else int(v), "ts": int(t)})
    return [(key[0], json.dumps(fields.flat_state({k: r["val"] for k, r in rows.items()}), sort_keys=True, separators=(",", ":")))]


per_group("micro_state", "SELECT * FROM oplog", ["doc_id"], "doc_id long, state string", _micro)


def _micro_commit(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Each op a change of its own, every ninth of them sent twice."""
    document = fields.FlatDocument()
    for i, o, p, v, t in zip(pdf["id"], pdf["op"], pdf["path"], pdf["value"], pdf["ts"]):
        for _ in range(2 if i % 9 == 0 else 1):
            document.commit(int(i), {p[1:].replace("/", "."): {"op": "!" if o == "remove" else "=", "val": None if o == "remove" else int(v), "ts": int(t)}})
    return [(key[0], k, r["op"], r["val"], r["ts"]) for k, r in document.fields.items()]


per_group(
    "micro_commit",
    "SELECT * FROM treelog",
    ["doc_id"],
    "doc_id long, key string, op string, val long, ts long",
    _micro_commit,
    """a AS (SELECT *, ts >= coalesce(max(ts) OVER (PARTITION BY doc_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) AS won FROM treelog),
  first AS (SELECT doc_id, path, min(seq) AS seq FROM treelog GROUP BY doc_id, path),
  c AS (SELECT doc_id, path, seq, ts, CASE op WHEN 'remove' THEN '!' ELSE '=' END AS op, CASE op WHEN 'replace' THEN value END AS val FROM treelog
    UNION ALL SELECT f.doc_id, f.path, a.seq, a.ts, '!', NULL FROM first f JOIN a ON a.doc_id = f.doc_id AND a.won AND starts_with(f.path, a.path || '/') AND a.seq > f.seq)
;
SELECT doc_id, replace(substr(path, 2), '/', '.') AS key, op, val, ts FROM c WHERE NOT EXISTS (SELECT 1 FROM c l WHERE l.doc_id = c.doc_id AND l.path = c.path AND (l.ts > c.ts OR l.ts = c.ts AND l.seq > c.seq))""",
)


def _oversized(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    out = []
    for s, o, p, v in zip(pdf["seq"], pdf["op"], pdf["path"], pdf["value"]):
        _, why = splitting.op_pieces({"op": o, "path": p} | ({} if o == "remove" else {"value": int(v)}), 34)
        out += [(key[0], int(s), why)] if why else []
    return out


per_group(
    "oversized_ops",
    "SELECT * FROM oplog",
    ["doc_id"],
    "doc_id long, seq long, reason string",
    _oversized,
    """SELECT doc_id, seq, CASE WHEN op = 'remove' THEN 'op-type' WHEN op = 'replace' THEN 'value-not-object' ELSE 'delta-op' END AS reason FROM oplog
      WHERE strlen(concat('{"op":"', op, '","path":"', path, '"', CASE WHEN op = 'remove' THEN '' ELSE concat(',"value":', value) END, '}')) > 34""",
)


# --- operational transform: changes of one document against what was committed beside them (F1 to F9) ---------
_BY_DOC = "SELECT *, rev AS seq FROM concurrent"


def changes_of(pdf: pd.DataFrame) -> list[dict]:
    return [{"id": int(i), "rev": int(r), "base_rev": int(b), "ops": json.loads(o)} for i, r, b, o in zip(pdf["id"], pdf["rev"], pdf["sent_base"], pdf["ops"])]


def _committed(sent: list[dict]) -> list[dict]:
    log = transform.Log()
    for q in sent:
        log.commit([q])
    return log.changes


def json_of(ops: list[dict]) -> str:
    return json.dumps(ops, separators=(",", ":"))


def _commit_flat(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    state: dict = {}
    for c in _committed(changes_of(pdf)):
        state = patch.apply(state, c["ops"], strict=True)
    return [(key[0], f"/{k}", v) for k, v in state.items()]


per_group("ot_commit", _BY_DOC, ["doc_id"], "doc_id long, path string, value long", _commit_flat, "SELECT doc_id, path, arg_max(k, rev) AS value FROM concurrent GROUP BY doc_id, path")


def _commit_list(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    state: dict = {"l": []}
    for c in _committed([q | {"ops": [{"op": "add", "path": "/l/0", "value": q["id"]}]} for q in changes_of(pdf)]):
        state = patch.apply(state, c["ops"], strict=True)
    return [(key[0], i, v) for i, v in enumerate(state["l"], 1)]


per_group("ot_commit_list", _BY_DOC, ["doc_id"], "doc_id long, pos long, id long", _commit_list, "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rev DESC) AS pos, id FROM concurrent")


def _commit_text(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    sent = [{"id": int(s), "rev": 0, "base_rev": 0, "ops": [{"op": "@txt", "path": "/body", "value": [{"insert": (t or "") + "\n"}]}]} for s, t in zip(pdf["seq"], pdf["text"])]
    state: dict = {}
    for c in _committed(sent):
        state = patch.apply(state, c["ops"], strict=True)
    return [(key[0], delta.plain(state["body"]))]


per_group(
    "ot_commit_text",
    "SELECT * FROM textlog",
    ["doc_id"],
    "doc_id long, body string",
    _commit_text,
    "SELECT doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY seq) || chr(10) || chr(10) AS body FROM textlog GROUP BY doc_id",
)


def _rebased(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    rows = changes_of(pdf)
    queue = transform.rebase([c for c in rows if c["rev"] <= 20], [c for c, who in zip(rows, pdf["client_id"]) if who == "c0" and c["rev"] > 10])
    return [(key[0], q["id"], q["base_rev"], q["rev"], json_of(q["ops"])) for q in queue]


per_group(
    "ot_rebase",
    _BY_DOC,
    ["doc_id"],
    "doc_id long, id long, base_rev long, rev long, ops string",
    _rebased,
    """SELECT c.doc_id, c.id, least(t.tip, 20) AS base_rev, least(t.tip, 20) + row_number() OVER (PARTITION BY c.doc_id ORDER BY c.rev) AS rev, c.ops
      FROM concurrent c JOIN tips t ON c.doc_id = t.doc_id WHERE c.client_id = 'c0' AND c.rev > 20""",
)
per_group(
    "ot_eject",
    _BY_DOC,
    ["doc_id"],
    "doc_id long, id long, rev long, ops string",
    lambda key, pdf: [(key[0], q["id"], q["rev"], json_of(q["ops"])) for q in transform.eject({}, changes_of(pdf), int(pdf["id"].iloc[min(2, len(pdf) - 1)]))],
    "SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY rev) AS rev, ops FROM concurrent WHERE rev <> (SELECT least(3, t.tip) FROM tips t WHERE t.doc_id = concurrent.doc_id)",
)


def _frame(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """A branch's foreign op lists advanced through its own queue, which is then discarded (H12)."""
    rows = changes_of(pdf)
    _, ahead = transform.behind([c for c in rows if c["id"] % 2], [c for c in rows if not c["id"] % 2])
    return [(key[0], len(ahead), sum(map(len, ahead)))]


per_group("frame_advance", _BY_DOC, ["doc_id"], "doc_id long, programs long, n_ops long", _frame)


def _reconstruct(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Replay that skips and reports a change that fails as a whole."""
    state, out = {"l": []}, []
    for r, k in zip(pdf["rev"], pdf["k"]):
        op = {"op": "add", "path": "/l/-", "value": int(k)} if k % 3 else {"op": "remove", "path": f"/l/{int(k) % 6}"}
        try:
            state = patch.apply(state, [op], strict=True)
        except patch.PatchError as e:
            out.append((key[0], int(r), str(e)))
    return out


per_group("skipped_changes", "SELECT *, rev AS seq FROM changelog", ["doc_id"], "doc_id long, rev long, error string", _reconstruct)


# --- sizes, splitting, compression, text logs and the merge guard (J1 to J10, K5, K6, H7) ----------------------------
def _split(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Turns inserted one behind the other, each change cut to 400 bytes; the pieces give the same text."""
    at, changes, whole = 0, [], {"body": [{"insert": "\n"}]}
    for s, t in zip(pdf["seq"], pdf["text"]):
        op = {"op": "@txt", "path": "/body", "value": [*([{"retain": at}] if at else []), {"insert": (t or "") + "\n"}]}
        at += delta.length({"insert": (t or "") + "\n"})
        changes.append({"id": f"{key[0]}.{s}", "rev": int(s) + 1, "ops": [op]})
    parts, report = splitting.split(changes, 400)
    state = whole
    for c in parts:
        state = patch.apply(state, c["ops"], strict=True)
    return [(key[0], len(changes), len(parts), len(report), delta.plain(state["body"]))]


per_group("split_changes", "SELECT * FROM textlog", ["doc_id"], "doc_id long, changes long, pieces long, oversized long, body string", _split)


def _packed(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    out = []
    for r, o in zip(pdf["rev"], pdf["ops"]):
        forms = (lz.from_base64(lz.to_base64(o)), lz.from_uri(lz.to_uri(o)), lz.from_utf16(lz.to_utf16(o)), lz.from_bytes(lz.to_bytes(o)))
        out.append((key[0], int(r), all(x == o for x in forms), o))
    return out


per_group("lz_round_trip", "SELECT *, rev AS seq FROM changelog", ["doc_id"], "doc_id long, rev long, alike boolean, ops string", _packed, "SELECT doc_id, rev, TRUE AS alike, ops FROM changelog")


def _text_log(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    log: list[tuple[int, list[dict]]] = []
    for rev, t in enumerate(pdf["text"], 1):
        log.append((rev, textlog.commit(log, 0, [{"insert": (t or "") + "\n"}])))
    (rev, whole), *_ = textlog.compact(log, len(log))
    return [(key[0], rev, delta.plain(whole))]


per_group(
    "text_log",
    "SELECT * FROM textlog",
    ["doc_id"],
    "doc_id long, rev long, body string",
    _text_log,
    "SELECT doc_id, count(*) AS rev, string_agg(coalesce(text, ''), chr(10) ORDER BY seq) || chr(10) AS body FROM textlog GROUP BY doc_id",
)


def _guard(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Each turn merged into the text of the first one: does it write that text again?"""
    first = pdf["text"].iloc[0] or ""
    return [(key[0], int(s), textlog.duplicated(first, [[{"insert": t or ""}]])) for s, t in zip(pdf["seq"], pdf["text"])]


per_group("merge_guard", "SELECT * FROM textlog", ["doc_id"], "doc_id long, seq long, duplicated boolean", _guard)


# --- states from snapshots and tails (E11, G7, G8, G10) --------------------------------------------------------
def _history(name: str, asked: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = prepare(spark).sql(spark_statement("SELECT doc_id, seq AS rev, path, op, value FROM setseq", sf_dir))
        return history.states(log, history.snapshots(log), spark.sql(spark_statement(asked, sf_dir)))

    QUERIES[name], ORACLES[name] = run, with_logs(oracle, "duckdb")


_LAST = "SELECT o.doc_id, q.at, o.path, arg_max(o.value, o.seq) AS value FROM setseq o JOIN q ON q.doc_id = o.doc_id AND o.seq <= q.at GROUP BY o.doc_id, q.at, o.path HAVING arg_max(o.op, o.seq) = 'replace'"
for _name, _asked in {
    "document_now": "SELECT doc_id, max(seq) AS at FROM setseq GROUP BY doc_id",
    "document_states": "SELECT doc_id, seq AS at FROM setseq WHERE seq % 10 = doc_id % 10",
    "states_before_versions": "SELECT v.doc_id, v.start_rev - 1 AS at FROM versions v WHERE v.start_rev > 1",
}.items():
    _history(_name, _asked, f"q AS ({_asked})\n;\n{_LAST}")
