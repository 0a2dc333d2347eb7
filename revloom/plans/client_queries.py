"""Queries of client layers, branches, versions and stores: what is confirmed, kept waiting, merged and written back.

Relational ones are statements with an oracle written another way; where ops must be walked in order, a document is one sorted group.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revloom.kernels import branching, builder, client, patch, textlog, transform
from revloom.operators import history, offload
from revloom.plans.kernel_queries import changes_of, json_of, per_group
from revloom.session import prepare
from revloom.sources.logs import spark_statement, with_logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(name: str, sql: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: prepare(spark).sql(spark_statement(sql, sf_dir))
    ORACLES[name] = with_logs(oracle, "duckdb")


def _frames(name: str, make: Callable, oracle: str) -> None:
    """make(table) -> DataFrame, where table(statement) reads the logs."""
    QUERIES[name] = lambda spark, sf_dir: make(lambda sql: prepare(spark).sql(spark_statement(sql, sf_dir)))
    ORACLES[name] = with_logs(oracle, "duckdb")


def _walked(name: str, sql: str, schema: str, make, oracle: str | None = None) -> None:
    per_group(name, sql, ["doc_id"], schema, make, oracle, QUERIES, ORACLES)


# --- confirmation of the sending layer (L2): committed up to 40, sent after it -----------------------------------
_UP = "explode(transform(sequence(2, size(split(path, '/')) - 1), n -> array_join(slice(split(path, '/'), 1, n), '/'))) AS up"
_sql(
    "confirm_sending",
    f"""c AS (SELECT doc_id, path, max_by(struct(op, value, ts), struct(ts, seq)) AS w FROM treelog WHERE seq <= 40 GROUP BY doc_id, path),
  s0 AS (SELECT doc_id, path, max(seq) AS seq, max_by(struct(op, value, ts), seq) AS w FROM treelog WHERE seq > 40 GROUP BY doc_id, path),
  gone AS (SELECT DISTINCT u.doc_id, u.path FROM (SELECT doc_id, path, seq, {_UP} FROM s0 WHERE size(split(path, '/')) > 2) u JOIN s0 p ON p.doc_id = u.doc_id AND p.path = u.up WHERE p.seq > u.seq),
  s AS (SELECT s0.* FROM s0 LEFT ANTI JOIN gone ON gone.doc_id = s0.doc_id AND gone.path = s0.path),
  j AS (SELECT s.doc_id, s.path, s.w AS mine, c.w AS theirs, c.w IS NULL OR s.w.ts >= c.w.ts AS won FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.path = s.path),
  under AS (SELECT DISTINCT u.doc_id, u.path FROM (SELECT doc_id, path, {_UP} FROM c WHERE size(split(path, '/')) > 2) u JOIN j ON j.doc_id = u.doc_id AND j.path = u.up WHERE j.won),
  r AS (SELECT doc_id, path, mine AS w, 'committed' AS layer FROM j WHERE won
    UNION ALL SELECT doc_id, path, theirs, 'correction' FROM j WHERE NOT won
    UNION ALL SELECT c.doc_id, c.path, c.w, 'committed' FROM c LEFT ANTI JOIN under ON under.doc_id = c.doc_id AND under.path = c.path LEFT ANTI JOIN (SELECT * FROM j WHERE won) n ON n.doc_id = c.doc_id AND n.path = c.path)
;
SELECT doc_id, path, layer, w.op AS op, CASE w.op WHEN 'replace' THEN w.value END AS value, w.ts AS ts FROM r""",
    """c AS (SELECT * FROM treelog a WHERE seq <= 40 AND NOT EXISTS (SELECT 1 FROM treelog b WHERE b.doc_id = a.doc_id AND b.path = a.path AND b.seq <= 40 AND (b.ts > a.ts OR b.ts = a.ts AND b.seq > a.seq))),
  s AS (SELECT * FROM treelog a WHERE seq > 40 AND NOT EXISTS (SELECT 1 FROM treelog b WHERE b.doc_id = a.doc_id AND b.seq > a.seq AND (b.path = a.path OR starts_with(a.path, b.path || '/')))),
  n AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = s.doc_id AND c.path = s.path AND c.ts > s.ts)),
  r AS (SELECT doc_id, path, 'committed' AS layer, op, value, ts FROM n
    UNION ALL SELECT c.doc_id, c.path, 'correction', c.op, c.value, c.ts FROM c JOIN s ON s.doc_id = c.doc_id AND s.path = c.path AND s.ts < c.ts
    UNION ALL SELECT doc_id, path, 'committed', op, value, ts FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = c.doc_id AND (n.path = c.path OR starts_with(c.path, n.path || '/'))))
;
SELECT doc_id, path, layer, op, CASE op WHEN 'replace' THEN value END AS value, ts FROM r""",
)

# --- the queue's upkeep (L9): what a server answered without goes; what was made since is numbered behind the new queue
_sql(
    "dropped_pending",
    "SELECT p.doc_id, p.id FROM changelog p LEFT ANTI JOIN received r ON r.doc_id = p.doc_id AND r.id = p.id WHERE p.client_id = 'c0'",
    "SELECT doc_id, id FROM changelog p WHERE client_id = 'c0' AND id NOT IN (SELECT id FROM received)",
)
_sql(
    "replaced_pending",
    """SELECT doc_id, id, 10 + row_number() OVER (PARTITION BY doc_id ORDER BY rev) AS rev FROM changelog WHERE client_id = 'c0' AND (rev > 40 OR rev > 10 AND id % 4 <> 0)""",
    """q AS (SELECT * FROM changelog WHERE client_id = 'c0' AND (rev > 40 OR rev > 10 AND id % 4 <> 0))
;
SELECT doc_id, id, 10 + (SELECT count(*) FROM q b WHERE b.doc_id = q.doc_id AND b.rev <= q.rev) AS rev FROM q""",
)

# --- installed states and buffered tails (L12, L13), documents that are followed (L14) ------------------------------
_sql(
    "installed_layers",
    """t AS (SELECT c.*, CAST(floor(t.tip / 25) * 25 AS BIGINT) AS base, t.tip - 5 AS head FROM changelog c JOIN tips t ON t.doc_id = c.doc_id)
;
SELECT doc_id, layer, path, max_by(k, rev) AS value, CASE layer WHEN 'snapshot' THEN max(base) ELSE max(rev) END AS rev
      FROM (SELECT *, CASE WHEN rev > head THEN 'pending' WHEN rev <= base THEN 'snapshot' ELSE 'committed' END AS layer FROM t) x GROUP BY doc_id, layer, path""",
    """t AS (SELECT c.*, CAST(floor(t.tip / 25) * 25 AS BIGINT) AS base, t.tip - 5 AS head FROM changelog c JOIN tips t ON t.doc_id = c.doc_id),
  x AS (SELECT doc_id, 'snapshot' AS layer, path, k, rev, base AS shown FROM t WHERE rev <= base AND rev <= head UNION ALL
    SELECT doc_id, 'committed', path, k, rev, rev FROM t WHERE rev > base AND rev <= head UNION ALL SELECT doc_id, 'pending', path, k, rev, rev FROM t WHERE rev > head)
;
SELECT doc_id, layer, path, k AS value, shown AS rev FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.doc_id = x.doc_id AND y.layer = x.layer AND y.path = x.path AND y.rev > x.rev)""",
)
_sql(
    "drained_tail",
    """b AS (SELECT doc_id, count(*) = max(rev) - 40 AS whole FROM received WHERE rev > 40 GROUP BY doc_id)
;
SELECT r.doc_id, r.rev, 'buffer' AS source FROM received r JOIN b ON b.doc_id = r.doc_id WHERE b.whole AND r.rev > 40
    UNION ALL SELECT c.doc_id, c.rev, 'fetched' FROM changelog c JOIN b ON b.doc_id = c.doc_id WHERE NOT b.whole AND c.rev > 40""",
    """m AS (SELECT DISTINCT c.doc_id FROM changelog c WHERE c.rev > 40 AND c.id % 13 = 0 AND EXISTS (SELECT 1 FROM received r WHERE r.doc_id = c.doc_id AND r.rev > c.rev))
;
SELECT doc_id, rev, 'fetched' AS source FROM changelog c WHERE rev > 40 AND doc_id IN (SELECT doc_id FROM m)
    UNION ALL SELECT doc_id, rev, 'buffer' FROM received c WHERE rev > 40 AND doc_id NOT IN (SELECT doc_id FROM m)""",
)
# k: 0 deletes, 1 and 2 follow, others commit their revision; a document that is followed again starts from revision 0
_sql(
    "tracked_docs",
    """e AS (SELECT doc_id, rev, k % 9 AS kind, max(CASE WHEN k % 9 <= 2 THEN struct(rev, k % 9 AS kind) END) OVER (PARTITION BY doc_id ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM changelog),
  f AS (SELECT doc_id, max(CASE WHEN kind = 0 OR kind <= 2 AND before.kind = 0 THEN rev END) AS at, max_by(kind, rev) FILTER (WHERE kind <= 2) = 0 AS deleted FROM e GROUP BY doc_id)
;
SELECT c.doc_id, coalesce(max(CASE WHEN c.k % 9 > 2 AND c.rev > coalesce(f.at, 0) THEN c.rev END), 0) AS committed_rev, coalesce(f.deleted, false) AS deleted FROM changelog c JOIN f ON f.doc_id = c.doc_id GROUP BY c.doc_id, f.deleted""",
    """d AS (SELECT doc_id, max(rev) FILTER (WHERE k % 9 = 0) AS gone, max(rev) FILTER (WHERE k % 9 IN (1, 2)) AS seen FROM changelog GROUP BY doc_id),
  s AS (SELECT d.*, coalesce((SELECT min(c.rev) FROM changelog c WHERE c.doc_id = d.doc_id AND c.rev > d.gone AND c.k % 9 IN (1, 2)), d.gone, 0) AS since FROM d)
;
SELECT doc_id, coalesce((SELECT max(c.rev) FROM changelog c WHERE c.doc_id = s.doc_id AND c.rev > s.since AND c.k % 9 > 2), 0) AS committed_rev, coalesce(gone > coalesce(seen, 0), false) AS deleted FROM s""",
)

# --- versions and their states (A8, G12 to G14), compaction (A6, E16) --------------------------------------------
_sql(
    "version_status",
    """a AS (SELECT doc_id, explode(sequence(1L, CAST(max(version) + 1 AS BIGINT))) AS version FROM versions GROUP BY doc_id)
;
SELECT a.doc_id, a.version, v.start_rev, v.end_rev, CASE WHEN v.version IS NULL THEN 'not-found' WHEN nullif(CASE WHEN a.version % 7 = 0 THEN '' ELSE 'x' END, '') IS NULL THEN 'missing-state' ELSE 'ok' END AS status
      FROM a LEFT JOIN versions v ON v.doc_id = a.doc_id AND v.version = a.version""",
    """SELECT doc_id, version, start_rev, end_rev, CASE WHEN version % 7 = 0 THEN 'missing-state' ELSE 'ok' END AS status FROM versions
    UNION ALL SELECT doc_id, max(version) + 1, NULL, NULL, 'not-found' FROM versions GROUP BY doc_id""",
)
_AT = {
    "built_versions": "SELECT doc_id, end_rev AS at FROM versions",
    "scrubbed_versions": "SELECT doc_id, start_rev - 1 AS at FROM versions UNION SELECT doc_id, CAST(floor((start_rev + end_rev) / 2) AS BIGINT) AS at FROM versions",
}
_LOG = "SELECT doc_id, seq AS rev, path, op, value FROM setlog"


def _states(asked: str) -> Callable:
    def make(table):
        log = table(_LOG)
        return history.states(log, history.snapshots(log), table(asked))

    return make


for _name, _asked in _AT.items():
    _frames(
        _name,
        _states(_asked),
        f"q AS ({_asked})\n;\nSELECT o.doc_id, q.at, o.path, arg_max(o.value, o.seq) AS value FROM setlog o JOIN q ON q.doc_id = o.doc_id AND o.seq <= q.at GROUP BY o.doc_id, q.at, o.path HAVING arg_max(o.op, o.seq) = 'replace'",
    )
_frames(
    "compacted_log",
    lambda table: history.compact(table(_LOG), 25),
    """b AS (SELECT doc_id, CAST(floor(max(seq) / 25) * 25 AS BIGINT) AS base FROM setlog GROUP BY doc_id)
;
SELECT s.doc_id, 'op' AS kind, s.seq AS rev, s.path, s.op, s.value FROM setlog s JOIN b ON b.doc_id = s.doc_id WHERE s.seq > b.base
    UNION ALL SELECT s.doc_id, 'snapshot', b.base, s.path, s.op, s.value FROM setlog s JOIN b ON b.doc_id = s.doc_id WHERE s.seq <= b.base AND s.op = 'replace'
      AND NOT EXISTS (SELECT 1 FROM setlog l WHERE l.doc_id = s.doc_id AND l.path = s.path AND l.seq > s.seq AND l.seq <= b.base)""",
)


# --- large values beside their table (A17) -----------------------------------------------------------------------
_KEYS, _TEXTS = ["doc_id", "seq"], "SELECT doc_id, seq, text FROM textlog"
_frames(
    "stored_values",
    lambda table: offload.stored(table(_TEXTS), _KEYS, "text", 200),
    "SELECT doc_id, seq, CASE WHEN coalesce(strlen(text), 0) <= 200 THEN text END AS text, CASE WHEN strlen(text) > 200 THEN doc_id || '/' || seq END AS ref FROM textlog",
)
_frames(
    "hydrated_values",
    lambda table: offload.hydrate(offload.stored(table(_TEXTS), _KEYS, "text", 200), offload.side(table(_TEXTS), _KEYS, "text", 200), "text"),
    _TEXTS,
)

# --- branches (H1 to H5) ------------------------------------------------------------------------------------------
# a branch has its own revisions: the copied state at 0, the copied rows at 1, its own content from 2 on
_sql(
    "lww_branch_copy",
    """w AS (SELECT b.doc_id, s.path, max_by(struct(s.op, s.value, s.ts), struct(s.ts, s.seq)) AS w FROM branches b JOIN setlog s ON s.doc_id = b.doc_id WHERE s.seq <= b.branched_at GROUP BY b.doc_id, s.path)
;
SELECT concat('branch-', CAST(doc_id AS STRING)) AS branch_id, 1 AS rev, path, w.op AS op, w.value AS value, w.ts AS ts FROM w
    UNION ALL SELECT concat('branch-', CAST(doc_id AS STRING)), 0, path, 'replace', w.value, NULL FROM w WHERE w.op = 'replace'""",
    """w AS (SELECT s.* FROM branches b JOIN setlog s ON s.doc_id = b.doc_id AND s.seq <= b.branched_at
    WHERE NOT EXISTS (SELECT 1 FROM setlog l WHERE l.doc_id = s.doc_id AND l.path = s.path AND l.seq <= b.branched_at AND (l.ts > s.ts OR l.ts = s.ts AND l.seq > s.seq)))
;
SELECT 'branch-' || doc_id AS branch_id, 1 AS rev, path, op, value, ts FROM w UNION ALL SELECT 'branch-' || doc_id, 0, path, op, value, NULL FROM w WHERE op = 'replace'""",
)
# after the branch point the source wrote the odd rows and the branch the even ones; of equal times the branch, which comes last, wins
_sql(
    "lww_branch_merge",
    """s AS (SELECT s.doc_id, s.path, s.op, s.value, s.ts, s.seq, s.seq > b.branched_at AND s.id % 2 = 0 AS own, b.merge_base FROM branches b JOIN setlog s ON s.doc_id = b.doc_id WHERE NOT b.deleted),
  w AS (SELECT doc_id, path, max_by(struct(op, value, ts, own), struct(ts, own, seq)) AS w FROM s WHERE NOT own OR seq > coalesce(merge_base, 0) GROUP BY doc_id, path)
;
SELECT doc_id, path, w.op AS op, CASE w.op WHEN 'replace' THEN w.value END AS value, w.ts AS ts, w.own AS merged FROM w""",
    """s AS (SELECT s.*, s.seq > b.branched_at AND s.id % 2 = 0 AS own FROM branches b JOIN setlog s ON s.doc_id = b.doc_id WHERE NOT b.deleted AND (s.seq <= b.branched_at OR s.id % 2 = 1 OR b.merge_base IS NULL OR s.seq > b.merge_base))
;
SELECT doc_id, path, op, CASE op WHEN 'replace' THEN value END AS value, ts, own AS merged FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY ts DESC, CAST(own AS INT) DESC, seq DESC) AS r FROM s) x WHERE r = 1""",
)
_frames(
    "ot_branch_seed",
    lambda table: history.branch_seeds(table(_LOG), table("SELECT doc_id, branched_at AS at FROM branches")),
    """l AS (SELECT b.doc_id, s.path, arg_max(s.value, s.seq) AS value FROM branches b JOIN setlog s ON s.doc_id = b.doc_id AND s.seq <= b.branched_at GROUP BY b.doc_id, s.path HAVING arg_max(s.op, s.seq) = 'replace')
;
SELECT 'branch-' || b.doc_id AS branch_id, 1 AS rev, '[{"op":"replace","path":"","value":{' || coalesce((SELECT string_agg('"' || substr(l.path, 2) || '":' || l.value, ',' ORDER BY l.path) FROM l WHERE l.doc_id = b.doc_id), '') || '}}]' AS ops FROM branches b""",
)


def _branched(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Even ids after the tenth revision are a branch's, the others the source's; each puts its id first in a list. Merged in windows of 7, twice: the second merge brings what the branch wrote after revision 30."""
    log, branch, state = transform.Log(), [], {"l": []}
    for i, r in zip(pdf["id"], pdf["rev"]):
        c = {"id": int(i), "ops": [{"op": "add", "path": "/l/0", "value": int(i)}]}
        if r > 10 and i % 2 == 0:
            branch.append(c | {"at": int(r)})
        else:
            log.changes.append(c | {"rev": len(log.changes) + 1})
    began = min(10, len(log.changes))
    for upto in (30, int(pdf["rev"].iloc[-1])):
        for window in branching.merge(log.changes, began, [c for c in branch if c["at"] <= upto], 7):
            log.changes += window
    for c in log.changes:
        state = patch.apply(state, c["ops"], strict=True)
    return [(key[0], i, v) for i, v in enumerate(state["l"], 1)]


_walked(
    "ot_branch_merge",
    "SELECT *, rev AS seq FROM changelog",
    "doc_id long, pos long, id long",
    _branched,
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN rev > 10 AND id % 2 = 0 THEN 1 ELSE 0 END DESC, rev DESC) AS pos, id FROM changelog",
)


# --- what a client shows and sends (F5 to F7, F15, L5 to L7, A11, K11) ----------------------------------------------
_BY_DOC = "SELECT *, rev AS seq FROM concurrent"


def _view(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Committed up to revision 30, received in two parts, under what c0 wrote since."""
    rows = changes_of(pdf)
    pending = [c | {"base_rev": 0} for c, who in zip(rows, pdf["client_id"]) if who == "c0" and c["rev"] > 30]
    state, rev = {}, 0
    for first, last in ((0, 20), (15, 30)):
        state, rev, pending = client.receive(state, rev, pending, [c for c in rows if first < c["rev"] <= last])
    return [(key[0], f"/{k}", v, rev, len(pending)) for k, v in client.view(state, rev, pending).items()]


_walked(
    "client_view",
    _BY_DOC,
    "doc_id long, path string, value long, rev long, pending long",
    _view,
    """SELECT doc_id, path, arg_max(k, rev) AS value, (SELECT least(30, t.tip) FROM tips t WHERE t.doc_id = c.doc_id) AS rev, (SELECT count(*) FROM concurrent p WHERE p.doc_id = c.doc_id AND p.client_id = 'c0' AND p.rev > 30) AS pending
      FROM concurrent c WHERE rev <= 30 OR client_id = 'c0' GROUP BY doc_id, path""",
)
_walked(
    "ot_rebase_indebted",
    _BY_DOC,
    "doc_id long, id long, base_rev long, rev long, ops string",
    lambda key, pdf: [
        (key[0], q["id"], q["base_rev"], q["rev"], json_of(q["ops"]))
        for q in branching.rebase_indebted([c for c in changes_of(pdf) if c["rev"] <= 20], [c for c, who in zip(changes_of(pdf), pdf["client_id"]) if who == "c0" and c["rev"] > 10], 20)
    ],
    """SELECT c.doc_id, c.id, CASE WHEN c.sent_base < 20 THEN c.sent_base ELSE 20 END AS base_rev, 20 + row_number() OVER (PARTITION BY c.doc_id ORDER BY c.rev) AS rev, c.ops
      FROM concurrent c WHERE c.client_id = 'c0' AND c.rev > 20""",
)


def _shown(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """List inserts behind those committed: three changes of the queue, then what is shown but not queued."""
    ops = [{"id": int(i), "ops": [{"op": "add", "path": "/l/0", "value": int(i)}]} for i in pdf["id"]]
    after = branching.optimistic(ops[:10], ops[10:13], [c["ops"] for c in ops[13:]])
    return [(key[0], n, json_of(o)) for n, o in enumerate(after, 1)]


_walked(
    "optimistic_rebase",
    "SELECT *, rev AS seq FROM changelog",
    "doc_id long, pos long, ops string",
    _shown,
    """SELECT doc_id, rev - 13 AS pos, '[{"op":"add","path":"/l/0","value":' || id || '}]' AS ops FROM changelog WHERE rev > 13""",
)


def _kept(pdf: pd.DataFrame) -> list[dict]:
    """Each row a change; a remove first copies the value, so it fails where there is none."""
    ops = ([{"op": "copy", "from": p, "path": "/last"}, {"op": o, "path": p}] if o == "remove" else [{"op": o, "path": p, "value": int(v)}] for o, p, v in zip(pdf["op"], pdf["path"], pdf["value"]))
    return [{"id": int(i), "ops": o} for i, o in zip(pdf["id"], ops)]


def _probed(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Does each change apply to an empty object where it was made? A change behind one that doesn't can't be told."""
    out, state, broken = [], {}, False
    for q in _kept(pdf):
        good = broken or branching.applies(state, [q], q["id"])
        out.append((key[0], q["id"], good))
        broken = broken or not good
        if not broken:
            state = patch.apply(state, q["ops"], strict=True)
    return out


_walked(
    "poison_probe",
    "SELECT * FROM setlog",
    "doc_id long, id long, good boolean",
    _probed,
    """e AS (SELECT *, op = 'remove' AND coalesce(lag(op) OVER (PARTITION BY doc_id, path ORDER BY seq), 'remove') = 'remove' AS bad FROM setlog)
;
SELECT doc_id, id, NOT bad OR EXISTS (SELECT 1 FROM e p WHERE p.doc_id = e.doc_id AND p.bad AND p.seq < e.seq) AS good FROM e""",
)


def _floored(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """A history is played until a change fails, the state reloaded, and played again, until failing changes are passed over."""
    rows, failures, state, at = _kept(pdf), branching.Failures(), {}, 0
    while at < len(rows):
        state, done, stopped = branching.pass_over(state, rows, failures, at)
        at += len(done)
        if stopped is not None:
            failures.reload()
    return [(key[0], i, n) for i, n in failures.count.items()]


_walked(
    "floored_changes",
    "SELECT * FROM setlog",
    "doc_id long, id long, failures long",
    _floored,
    """e AS (SELECT *, op = 'remove' AND coalesce(lag(op) OVER (PARTITION BY doc_id, path ORDER BY seq), 'remove') = 'remove' AS bad FROM setlog)
;
SELECT doc_id, id, 2 AS failures FROM e WHERE bad""",
)


def _swapped(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """Each change tries to move a branch's mark to its revision: a third expect no mark, a third the revision before, the others nothing."""
    row, won = {}, 0
    for r, k in zip(pdf["rev"], pdf["k"]):
        new = branching.swap({"merged": int(r)}, row, ({"merged": None}, {"merged": int(r) - 1}, {})[int(k) % 3])
        row, won = (row, won) if new is None else (new, won + 1)
    return [(key[0], row.get("merged"), won)]


# one without expectation always moves it, one that expects no mark only before all others, one that expects the revision before as that one did
_walked(
    "branch_swaps",
    "SELECT *, rev AS seq FROM changelog",
    "doc_id long, merged long, won long",
    _swapped,
    """n AS (SELECT doc_id, rev, k % 3 = 2 OR rev = min(rev) OVER (PARTITION BY doc_id) AS won FROM changelog WHERE k % 3 <> 1),
  c AS (SELECT doc_id, rev, coalesce((SELECT arg_max(n.won, n.rev) FROM n WHERE n.doc_id = c.doc_id AND n.rev <= c.rev), false) AS won FROM changelog c)
;
SELECT doc_id, max(rev) FILTER (WHERE won) AS merged, count(*) FILTER (WHERE won) AS won FROM c GROUP BY doc_id""",
)


def _sizes(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    return [(key[0], r, builder.stored_size({"rev": r, "ops": json.loads(o)}), builder.stored_size({"rev": r, "ops": json.loads(o)}, "bytes")) for r, o in zip(map(int, pdf["rev"]), pdf["ops"])]


_walked("stored_sizes", "SELECT *, rev AS seq FROM changelog", "doc_id long, rev long, base64 long, bytes long", _sizes)


def _held(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
    """A client's own turn waits while the others' come in one by one, each at the text's start; a missing one calls for a new state."""
    turns = [[{"insert": (t or "") + "\n"}] for t in pdf["text"]]
    held, got = textlog.Held(0, turns[0], turns[-1]), 0
    for rev, t in enumerate(turns[1:-1], 1):
        got += held.receive(rev, t) is not None
    at = [0 if "retain" not in x[0] else x[0]["retain"] for x in (held.sending, held.pending)]
    return [(key[0], held.rev, got, *at)]


_walked(
    "held_texts",
    _TEXTS,
    "doc_id long, rev long, received long, sending_at long, pending_at long",
    _held,
    """x AS (SELECT doc_id, count(*) AS n, sum(length(coalesce(text, '')) + 1) FILTER (WHERE NOT edge) AS before FROM (SELECT *, seq = min(seq) OVER (PARTITION BY doc_id) OR seq = max(seq) OVER (PARTITION BY doc_id) AS edge FROM textlog) t GROUP BY doc_id)
;
SELECT doc_id, greatest(n - 2, 0) AS rev, greatest(n - 2, 0) AS received, coalesce(before, 0) AS sending_at, coalesce(before, 0) AS pending_at FROM x""",
)
