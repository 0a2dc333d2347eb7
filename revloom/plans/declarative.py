"""Queries that are relational all the way: log reads, field resolution, versions, branches, delivery.

A statement is written once where both dialects agree, and twice where the engine has a better form
(max_by over a struct, an ordered fold with aggregate) or the oracle should be found another way. Every one
is keyed by document, so Catalyst shuffles once by doc_id for windows and aggregates in a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revloom.session import prepare
from revloom.sources.logs import spark_statement, with_logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prepare(spark).sql(spark_statement(sql, sf_dir))

    QUERIES[name], ORACLES[name] = run, with_logs(oracle or sql, "duckdb")


# --- fields under last-write-wins (E1, E2, A4) -------------------------------------------------
add(
    "lww_set_fields",
    """SELECT doc_id, path, w.value AS value FROM (SELECT doc_id, path, max_by(struct(op, value), struct(ts, seq)) AS w FROM setlog GROUP BY doc_id, path) x WHERE w.op = 'replace'""",
    """SELECT doc_id, path, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY ts DESC, seq DESC) AS r FROM setlog) x WHERE r = 1 AND op = 'replace'""",
)
add(
    "lww_multiwriter",
    """SELECT doc_id, field, w.quantity AS quantity, w.price AS price FROM (SELECT doc_id, field,
        max_by(struct(quantity, price), struct(ts, l_partkey, l_suppkey, quantity, price, discount, tax, l_returnflag, l_linestatus)) AS w FROM multiwriter GROUP BY doc_id, field) x""",
    """SELECT doc_id, field, quantity, price FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field
        ORDER BY ts DESC, l_partkey DESC, l_suppkey DESC, quantity DESC, price DESC, discount DESC, tax DESC, l_returnflag DESC, l_linestatus DESC) AS r FROM multiwriter) x WHERE r = 1""",
)

# the ordered fold of set, remove and delta ops on one field (E2), then concrete values (E4)
_STEP = """CASE WHEN acc.op IS NULL THEN {new}
    WHEN substr(x.op, 1, 1) = '@' AND acc.op = 'remove' THEN {fresh}
    WHEN substr(x.op, 1, 1) = '@' AND {v} = acc.value THEN acc
    WHEN substr(x.op, 1, 1) = '@' THEN {both}
    WHEN acc.ts > x.ts THEN acc ELSE {new} END"""
_VALUE = "(CASE x.op WHEN '@inc' THEN acc.value + x.value WHEN '@max' THEN greatest(acc.value, x.value) ELSE least(acc.value, x.value) END)"


def _fold(make: str) -> str:
    def row(op: str, value: str, ts: str) -> str:
        return make.format(op=op, value=value, ts=ts)

    return _STEP.format(new=row("x.op", "x.value", "x.ts"), fresh=row("'replace'", "x.value", "greatest(acc.ts, x.ts)"), both=row("acc.op", _VALUE, "greatest(acc.ts, x.ts)"), v=_VALUE)


_S = "named_struct('op', {op}, 'value', {value}, 'ts', {ts})"
_D = "{{'op': {op}, 'value': {value}, 'ts': {ts}}}"
for _name, _what in (("lww_consolidate_fields", "acc.op AS op, acc.value AS value, acc.ts AS ts"), ("lww_concrete_values", "acc.value AS value")):
    _where = " WHERE acc.op <> 'remove'" if _name == "lww_concrete_values" else ""
    add(
        _name,
        f"""SELECT doc_id, path, {_what} FROM (SELECT doc_id, path, aggregate(array_sort(collect_list(struct(seq, op, value, ts))),
            named_struct('op', CAST(NULL AS STRING), 'value', CAST(NULL AS BIGINT), 'ts', CAST(NULL AS BIGINT)), (acc, x) -> {_fold(_S)}) AS acc FROM oplog GROUP BY doc_id, path) f{_where}""",
        f"""SELECT doc_id, path, {_what} FROM (SELECT doc_id, path, list_reduce(list({{'op': op, 'value': value, 'ts': ts}} ORDER BY seq), lambda acc, x: {_fold(_D)},
            {{'op': CAST(NULL AS VARCHAR), 'value': CAST(NULL AS BIGINT), 'ts': CAST(NULL AS BIGINT)}}) AS acc FROM oplog GROUP BY doc_id, path) f{_where}""",
    )
add("delta_sums", """SELECT doc_id, path, sum(CASE WHEN op = '@inc' THEN value END) AS inc, max(CASE WHEN op = '@max' THEN value END) AS hi, min(CASE WHEN op = '@min' THEN value END) AS lo FROM oplog GROUP BY doc_id, path""")
add(
    "bitmask_fold",
    """SELECT doc_id, aggregate(array_sort(collect_list(struct(seq, value))), named_struct('on', 0L, 'off', 0L), (acc, x) -> named_struct(
        'on', (acc.on & ~shiftleft(x.value % 2, CAST(x.value % 15 AS INT))) | shiftleft(1 - x.value % 2, CAST(x.value % 15 AS INT)),
        'off', (acc.off & ~shiftleft(1 - x.value % 2, CAST(x.value % 15 AS INT))) | shiftleft(x.value % 2, CAST(x.value % 15 AS INT))), acc -> shiftleft(acc.off, 15) | acc.on) AS mask FROM oplog GROUP BY doc_id""",
    """SELECT doc_id, CAST(sum(CASE WHEN value % 2 = 0 THEN 1 << CAST(bit AS INT) ELSE 1 << CAST(bit + 15 AS INT) END) AS BIGINT) AS mask FROM (
        SELECT *, value % 15 AS bit, row_number() OVER (PARTITION BY doc_id, value % 15 ORDER BY seq DESC) AS r FROM oplog) x WHERE r = 1 GROUP BY doc_id""",
)
add("lww_delta_to_missing", """SELECT doc_id, seq, path, CASE WHEN op = 'remove' THEN 'remove' ELSE 'replace' END AS op, CASE WHEN op = 'remove' THEN NULL ELSE value END AS value FROM oplog""")
add("lww_changes_since", """SELECT doc_id, path, op, value, seq AS rev, ts, row_number() OVER (PARTITION BY doc_id ORDER BY seq, ts) AS pos, max(ts) OVER (PARTITION BY doc_id) AS committed_at FROM oplog WHERE seq > 20""")
add(
    "lww_echo_set",
    """SELECT t.doc_id, t.path, t.seq FROM treelog t WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT doc_id, path FROM treelog WHERE seq <= 2) s
        WHERE s.doc_id = t.doc_id AND (t.path = s.path OR startswith(t.path, concat(s.path, '/')))) OR t.seq > 60""",
    """SELECT DISTINCT t.doc_id, t.path, t.seq FROM treelog t LEFT JOIN treelog s ON s.doc_id = t.doc_id AND s.seq <= 2 AND (t.path = s.path OR starts_with(t.path, s.path || '/')) WHERE s.doc_id IS NOT NULL OR t.seq > 60""",
)
# what the server sent, with local ops on top: deltas act on its values, other local ops win, untouched ones are kept
add(
    "lww_server_local_merge",
    """SELECT doc_id, path, CASE WHEN l.w.op IS NULL THEN s.w.op WHEN s.w.op IS NULL OR substr(l.w.op, 1, 1) <> '@' THEN l.w.op ELSE 'replace' END AS op,
        CASE WHEN l.w.op IS NULL THEN IF(s.w.op = 'remove', NULL, s.w.value) WHEN l.w.op = 'remove' THEN NULL WHEN s.w.op IS NULL OR s.w.op = 'remove' OR l.w.op = 'replace' THEN l.w.value
          WHEN l.w.op = '@inc' THEN s.w.value + l.w.value WHEN l.w.op = '@max' THEN greatest(s.w.value, l.w.value) ELSE least(s.w.value, l.w.value) END AS value
      FROM (SELECT doc_id, path, max_by(struct(op, value), struct(ts, seq)) AS w FROM setlog WHERE seq <= 30 GROUP BY doc_id, path) s
      FULL OUTER JOIN (SELECT doc_id, path, max_by(struct(op, value), seq) AS w FROM oplog WHERE seq > 30 GROUP BY doc_id, path) l USING (doc_id, path)""",
    """l AS (SELECT * FROM oplog o WHERE seq > 30 AND NOT EXISTS (SELECT 1 FROM oplog p WHERE p.doc_id = o.doc_id AND p.path = o.path AND p.seq > o.seq)),
  s AS (SELECT * FROM setlog o WHERE seq <= 30 AND NOT EXISTS (SELECT 1 FROM setlog p WHERE p.seq <= 30 AND p.doc_id = o.doc_id AND p.path = o.path AND (p.ts > o.ts OR p.ts = o.ts AND p.seq > o.seq)))
;
SELECT doc_id, path, op, CASE WHEN op = 'replace' THEN value END AS value FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = s.doc_id AND l.path = s.path)
      UNION ALL SELECT doc_id, path, op, CASE WHEN op <> 'remove' THEN value END FROM l WHERE NOT starts_with(op, '@') OR NOT EXISTS (SELECT 1 FROM s WHERE l.doc_id = s.doc_id AND l.path = s.path)
      UNION ALL SELECT l.doc_id, l.path, 'replace', CASE WHEN s.op = 'remove' THEN l.value WHEN l.op = '@inc' THEN l.value + s.value WHEN l.op = '@max' THEN greatest(l.value, s.value) ELSE least(l.value, s.value) END
        FROM l JOIN s ON l.doc_id = s.doc_id AND l.path = s.path WHERE starts_with(l.op, '@')""",
)
# a server op below a field that a local set or remove holds is dropped
add(
    "lww_parent_shield",
    """SELECT s.doc_id, s.path, s.seq FROM (SELECT *, transform(sequence(2, size(split(path, '/')) - 1), n -> array_join(slice(split(path, '/'), 1, n), '/')) AS above FROM treelog WHERE seq <= 30 AND size(split(path, '/')) > 2
        UNION ALL SELECT *, CAST(array() AS array<string>) AS above FROM treelog WHERE seq <= 30 AND size(split(path, '/')) <= 2) s
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT doc_id, path FROM treelog WHERE seq > 30) l WHERE l.doc_id = s.doc_id AND array_contains(s.above, l.path))""",
    "SELECT doc_id, path, seq FROM treelog s WHERE seq <= 30 AND NOT EXISTS (SELECT 1 FROM treelog l WHERE l.doc_id = s.doc_id AND l.seq > 30 AND starts_with(s.path, l.path || '/'))",
)
add("lww_compaction_due", "SELECT doc_id, count(*) AS rows_kept, count(*) >= 200 AS due FROM oplog GROUP BY doc_id")

# --- reading and writing the log (A1 to A14, F10 to F16, F20) ------------------------------------
add("scan_changes", "SELECT doc_id, rev, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rev) AS r FROM changelog WHERE rev > 5 AND rev < 40) x WHERE r <= 10")
add("scan_changes_reverse", "SELECT doc_id, rev, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rev DESC) AS r FROM changelog WHERE batch_id <> 'b7') x WHERE r <= 3")
add("scan_changes_bytes", """SELECT doc_id, rev, used FROM (SELECT doc_id, rev, row_number() OVER w AS r, sum({LEN}(ops)) OVER w AS used FROM changelog WINDOW w AS (PARTITION BY doc_id ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x WHERE used <= 400 OR r = 1""")
add("append_violations", "SELECT doc_id, id, count(*) AS n FROM resent GROUP BY doc_id, id HAVING count(*) > 1", "SELECT doc_id, id, 2 AS n FROM changelog WHERE id % 9 = 0")
add("current_rev", "SELECT doc_id, coalesce(max(rev), 0) AS rev FROM changelog GROUP BY doc_id")
add("ops_since_rev", "SELECT doc_id, path, op, value, seq AS rev FROM oplog WHERE seq > 40")
add("ops_by_paths", "SELECT doc_id, path, op, value, seq AS rev FROM oplog WHERE path IN ('/f1', '/f3')")
add("snapshot_tail", "SELECT c.doc_id, c.rev, c.id FROM changelog c JOIN tips t ON c.doc_id = t.doc_id WHERE c.rev > floor(t.tip / 25) * 25")
add("list_versions", """SELECT doc_id, version, start_rev FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_rev) AS r FROM versions WHERE origin = 'main' AND start_rev > 3) x WHERE r <= 4""")
add("list_versions_reverse", """SELECT doc_id, version, start_rev FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_rev DESC) AS r FROM versions WHERE start_rev < 30) x WHERE r <= 4""")
add("list_branches", "SELECT doc_id, branched_at, deleted FROM branches WHERE NOT deleted")
add("list_branches_since", "SELECT doc_id, branched_at, deleted FROM branches WHERE modified_at > 60000")
add("live_documents", "SELECT t.doc_id, t.tip FROM tips t LEFT ANTI JOIN (SELECT doc_id FROM tombstones WHERE expires_at > 60000) d ON t.doc_id = d.doc_id", "SELECT doc_id, tip FROM tips WHERE doc_id NOT IN (SELECT doc_id FROM tombstones WHERE expires_at > 60000)")
add("seen_change_ids", "SELECT c.doc_id, c.id FROM changelog c LEFT SEMI JOIN (SELECT doc_id, id FROM changelog WHERE created_at + 2592000000 > 1706400000000 AND rev % 2 = 0) s ON c.doc_id = s.doc_id AND c.id = s.id", "SELECT doc_id, id FROM changelog WHERE created_at + 2592000000 > 1706400000000 AND rev % 2 = 0")
add("offloaded_values", "SELECT doc_id, rev, CASE WHEN {LEN}(ops) > 40 THEN concat('ref:', CAST(id AS STRING)) ELSE ops END AS stored FROM changelog")
add("upload_owner", "SELECT doc_id, min(rev) AS first_rev, max(CASE WHEN rev = 1 THEN batch_id END) AS batch_id FROM changelog GROUP BY doc_id")
# what of a batch is new: of each id the first that was sent, unless it is committed already
add("dedup_batch", "SELECT doc_id, id, rev FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY rev, copy) AS r FROM resent) x LEFT ANTI JOIN (SELECT doc_id AS d, id AS i FROM changelog WHERE rev <= 10) known ON d = doc_id AND i = id WHERE r = 1",
    "SELECT DISTINCT doc_id, id, rev FROM resent x WHERE NOT EXISTS (SELECT 1 FROM changelog c WHERE c.doc_id = x.doc_id AND c.id = x.id AND c.rev <= 10)")
add("own_echoes", "SELECT c.doc_id, c.rev, c.id FROM changelog c JOIN changelog f ON f.doc_id = c.doc_id AND f.rev = 1 WHERE c.client_id = f.client_id AND c.rev > 1 AND (c.batch_id = f.batch_id OR c.id = f.id)")
add("catch_up", "SELECT doc_id, rev, id, kind FROM (SELECT doc_id, rev, id, 'foreign' AS kind FROM concurrent WHERE rev > sent_base + 2 AND client_id <> 'c0' UNION ALL SELECT doc_id, rev, id, 'echo' AS kind FROM concurrent WHERE client_id = 'c0' AND rev % 3 = 0) x")
# the leading changes that were made on one base
add("frame_prefix", """SELECT doc_id, rev FROM (SELECT doc_id, rev, max(CASE WHEN sent_base <> first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken
      FROM (SELECT *, first_value(sent_base) OVER (PARTITION BY doc_id ORDER BY rev) AS first FROM concurrent) x) y WHERE broken = 0""",
    """SELECT c.doc_id, c.rev FROM concurrent c JOIN concurrent f ON f.doc_id = c.doc_id AND f.rev = 1 WHERE NOT EXISTS (SELECT 1 FROM concurrent o WHERE o.doc_id = c.doc_id AND o.rev <= c.rev AND o.sent_base <> f.sent_base)""")
add("contiguity_gaps", """SELECT doc_id, rev, prev FROM (SELECT doc_id, rev, lag(rev) OVER (PARTITION BY doc_id ORDER BY rev) AS prev FROM changelog WHERE id % 11 <> 0) x WHERE rev <> coalesce(prev, 0) + 1""")
add("committed_and_pending", "SELECT doc_id, rev, id, pending FROM (SELECT doc_id, rev, id, FALSE AS pending FROM changelog WHERE rev <= 40 UNION ALL SELECT doc_id, rev, id, TRUE AS pending FROM changelog WHERE rev > 40) x WHERE rev > 35")

# --- scalars (D) ------------------------------------------------------------------------------
add("pointer_functions", """SELECT doc_id, seq, substring_index(path, '/', -1) AS last, substr(path, 1, length(path) - length(substring_index(path, '/', -1))) AS prefix,
        replace(replace(concat('a/', CAST(value AS STRING), '~'), '~', '~0'), '/', '~1') AS escaped, path RLIKE '/(0|[1-9][0-9]*)$' AS numeric_tail FROM treelog""",
    """SELECT doc_id, seq, string_split(path, '/')[-1] AS last, substr(path, 1, length(path) - length(string_split(path, '/')[-1])) AS prefix,
        replace(replace(concat('a/', CAST(value AS STRING), '~'), '~', '~0'), '/', '~1') AS escaped, regexp_matches(path, '/(0|[1-9][0-9]*)$') AS numeric_tail FROM treelog""")
add("change_bytes", "SELECT doc_id, sum({LEN}(ops)) AS bytes, max({LEN}(ops)) AS largest FROM changelog GROUP BY doc_id")
add("ancestors", """SELECT c.doc_id, c.path, c.up AS parent FROM (SELECT doc_id, path, explode(transform(sequence(2, size(split(path, '/')) - 1), n -> array_join(slice(split(path, '/'), 1, n), '/'))) AS up
        FROM (SELECT DISTINCT doc_id, path FROM treelog WHERE size(split(path, '/')) > 2) p) c LEFT SEMI JOIN (SELECT DISTINCT doc_id AS d, path AS p FROM treelog) q ON c.doc_id = q.d AND c.up = q.p""",
    "SELECT DISTINCT c.doc_id, c.path, p.path AS parent FROM treelog c JOIN treelog p ON c.doc_id = p.doc_id AND starts_with(c.path, p.path || '/')")

# --- inverse, composition (C2, C3, flat) -----------------------------------------------------------
# removing what isn't there does nothing, and nothing undoes it
add("invert_flat", """SELECT doc_id, seq, path, CASE WHEN prev IS NULL OR prev_op = 'remove' THEN 'remove' WHEN op = 'remove' THEN 'add' ELSE 'replace' END AS op, CASE WHEN prev_op <> 'remove' THEN prev END AS value
      FROM (SELECT *, lag(value) OVER w AS prev, lag(op) OVER w AS prev_op FROM setlog WINDOW w AS (PARTITION BY doc_id, path ORDER BY seq)) x WHERE NOT (op = 'remove' AND coalesce(prev_op, 'remove') = 'remove')""",
    """SELECT s.doc_id, s.seq, s.path, CASE WHEN p.seq IS NULL OR p.op = 'remove' THEN 'remove' WHEN s.op = 'remove' THEN 'add' ELSE 'replace' END AS op, CASE WHEN p.op = 'replace' THEN p.value END AS value
      FROM setlog s LEFT JOIN setlog p ON p.doc_id = s.doc_id AND p.path = s.path AND p.seq = (SELECT max(q.seq) FROM setlog q WHERE q.doc_id = s.doc_id AND q.path = s.path AND q.seq < s.seq)
      WHERE s.op = 'replace' OR p.op = 'replace'""")
# a run ends where its field's op changes, and everywhere where the document has an op that doesn't compose
add("compose_runs", """SELECT doc_id, path, op, min(seq) AS first_seq, CASE op WHEN '@inc' THEN sum(value) WHEN '@max' THEN max(value) WHEN '@min' THEN min(value) ELSE max_by(value, seq) END AS value FROM (
        SELECT *, sum(CASE WHEN prev = op THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
        FROM (SELECT *, lag(op) OVER (PARTITION BY doc_id, path, ended ORDER BY seq) AS prev
          FROM (SELECT *, sum(CASE WHEN op = 'remove' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM oplog) e WHERE op <> 'remove') x) y GROUP BY doc_id, path, op, run""",
    """SELECT f.doc_id, f.path, f.op, f.seq AS first_seq, CASE f.op WHEN '@inc' THEN sum(m.value) WHEN '@max' THEN max(m.value) WHEN '@min' THEN min(m.value) ELSE arg_max(m.value, m.seq) END AS value
      FROM (SELECT a.*, (SELECT min(z.seq) FROM oplog z WHERE z.doc_id = a.doc_id AND z.seq > a.seq AND (z.op = 'remove' OR z.path = a.path AND z.op <> a.op)) AS upto FROM oplog a
        LEFT JOIN oplog b ON b.doc_id = a.doc_id AND b.path = a.path AND b.seq = (SELECT max(q.seq) FROM oplog q WHERE q.doc_id = a.doc_id AND q.path = a.path AND q.seq < a.seq)
        WHERE a.op <> 'remove' AND (b.seq IS NULL OR b.op <> a.op OR EXISTS (SELECT 1 FROM oplog r WHERE r.doc_id = a.doc_id AND r.op = 'remove' AND r.seq > b.seq AND r.seq < a.seq))) f
      JOIN oplog m ON m.doc_id = f.doc_id AND m.path = f.path AND m.seq >= f.seq AND (f.upto IS NULL OR m.seq < f.upto) GROUP BY f.doc_id, f.path, f.op, f.seq""")

# --- versions and as-of reads (G) ---------------------------------------------------------------
add("sessions_versions", "SELECT doc_id, version, start_rev, end_rev, started_at, ended_at, lag(version) OVER (PARTITION BY doc_id ORDER BY version) AS parent FROM versions")
add("session_trigger", "SELECT doc_id, rev, created_at - prev > 1800000 AS cut FROM sessions WHERE prev IS NOT NULL")
add("count_trigger", "SELECT doc_id, rev, floor((rev - 1) / 25) < floor(rev / 25) AS cut FROM changelog")
add("catch_up_steps", "SELECT doc_id, s AS start_rev, least(s + 9, tip) AS end_rev FROM (SELECT doc_id, tip, explode(sequence(1L, tip, 10L)) AS s FROM tips) x", "SELECT doc_id, s AS start_rev, least(s + 9, tip) AS end_rev FROM (SELECT doc_id, tip, unnest(generate_series(1, tip, 10)) AS s FROM tips) x")
add(
    "latest_main_version",
    """SELECT doc_id, rev, last_value(CASE WHEN kind = 0 THEN version END, true) OVER (PARTITION BY doc_id ORDER BY rev, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version, kind
      FROM (SELECT doc_id, end_rev AS rev, version, 0 AS kind FROM versions WHERE origin = 'main' UNION ALL SELECT doc_id, rev, NULL, 1 FROM changelog) x""",
    """SELECT doc_id, rev, version, 0 AS kind FROM (SELECT doc_id, end_rev AS rev, version FROM versions WHERE origin = 'main') a UNION ALL
      SELECT c.doc_id, c.rev, max(v.version), 1 FROM changelog c LEFT JOIN versions v ON v.doc_id = c.doc_id AND v.origin = 'main' AND v.end_rev <= c.rev GROUP BY c.doc_id, c.rev""",
)
add("state_at_rev", """SELECT doc_id, path, w.k AS value FROM (SELECT doc_id, path, max_by(struct(k), rev) AS w FROM changelog WHERE rev <= 25 GROUP BY doc_id, path) x""", """SELECT doc_id, path, arg_max(k, rev) AS value FROM changelog WHERE rev <= 25 GROUP BY doc_id, path""")
# what is to be replayed on the last main version by revision 30, from the start where there is none
add("tail_after_version", "SELECT c.doc_id, c.rev, coalesce(v.end_rev, 0) AS version_rev FROM changelog c LEFT JOIN (SELECT doc_id, max(end_rev) AS end_rev FROM versions WHERE origin = 'main' AND end_rev <= 30 GROUP BY doc_id) v ON c.doc_id = v.doc_id WHERE c.rev > coalesce(v.end_rev, 0) AND c.rev <= 30",
    "SELECT c.doc_id, c.rev, coalesce((SELECT max(v.end_rev) FROM versions v WHERE v.doc_id = c.doc_id AND v.origin = 'main' AND v.end_rev <= 30), 0) AS version_rev FROM changelog c WHERE c.rev <= 30 AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.doc_id = c.doc_id AND v.origin = 'main' AND v.end_rev <= 30 AND v.end_rev >= c.rev)")
# the nearest main version among the ten before
add("version_parents", "SELECT doc_id, version, base FROM (SELECT doc_id, version, max(CASE WHEN origin = 'main' THEN version END) OVER (PARTITION BY doc_id ORDER BY version ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS base FROM versions) x WHERE base IS NOT NULL",
    "SELECT a.doc_id, a.version, max(b.version) AS base FROM versions a JOIN versions b ON a.doc_id = b.doc_id AND b.origin = 'main' AND b.version < a.version AND b.version >= a.version - 10 GROUP BY a.doc_id, a.version")
add("snapshot_envelope", """SELECT doc_id, concat('{"state":', CAST(max(k) AS STRING), ',"rev":', CAST(max(rev) AS STRING), ',"changes":', CAST(count(*) AS STRING), '}') AS envelope FROM changelog GROUP BY doc_id""")
add("scrub_prefix", "SELECT doc_id, session, rev FROM (SELECT doc_id, session, rev, row_number() OVER (PARTITION BY doc_id, session ORDER BY rev) AS r FROM sessions) x WHERE r <= 2")

# --- branches (H) --------------------------------------------------------------------------------
add("branch_copy", "SELECT concat('branch-', CAST(b.doc_id AS STRING)) AS branch_id, c.path, max(c.rev) AS source_rev, 1 AS rev FROM branches b JOIN changelog c ON c.doc_id = b.doc_id AND c.rev <= b.branched_at GROUP BY b.doc_id, c.path")
add("branch_merge_ops", "SELECT b.doc_id, c.path, max(c.rev) AS rev, count(*) AS n FROM branches b JOIN changelog c ON c.doc_id = b.doc_id WHERE c.rev > b.branched_at AND c.rev % 2 = 0 AND NOT b.deleted GROUP BY b.doc_id, c.path")
add("merge_base", "SELECT doc_id, coalesce(merge_base, least(branched_at, tip)) AS base FROM branches")
add("version_copy", "SELECT v.doc_id, v.version, b.tip + greatest(0, least(v.start_rev, b.tip) - b.branched_at) AS start_rev, b.tip + greatest(0, least(v.end_rev, b.tip) - b.branched_at) AS end_rev FROM versions v JOIN branches b ON v.doc_id = b.doc_id WHERE v.end_rev > b.branched_at")
add("forward_watermark", "SELECT doc_id, greatest(branched_at, coalesce(merge_base, 0)) AS watermark FROM branches")
add("byte_budget_window", """SELECT doc_id, max(rev) AS upto FROM (SELECT doc_id, rev, row_number() OVER w AS r, sum({LEN}(ops)) OVER w AS used FROM changelog WINDOW w AS (PARTITION BY doc_id ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x WHERE used <= 1000 OR r = 1 GROUP BY doc_id""")
add("branch_guards", "SELECT doc_id, CASE WHEN deleted THEN 'deleted' WHEN branched_at = 0 THEN 'empty' ELSE 'ok' END AS status FROM branches")

# --- ordering (I3, I4) -----------------------------------------------------------------------------
_ORDER = "concat('a', CAST(k % 10 AS STRING))"
add("sorted_items", f"SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}, CAST(id AS STRING)) AS pos FROM changelog")
add("duplicate_orders", f"SELECT doc_id, id FROM (SELECT doc_id, id, ord, lag(ord) OVER (PARTITION BY doc_id ORDER BY ord, CAST(id AS STRING)) AS prev FROM (SELECT doc_id, id, {_ORDER} AS ord FROM changelog) x) y WHERE ord = prev")

# --- greedy batches (J2): an ordered fold, as sums restart ---------------------------------------
add(
    "greedy_batches",
    """SELECT doc_id, acc.n AS batches, acc.size AS last_bytes FROM (SELECT doc_id, aggregate(array_sort(collect_list(struct(rev, CAST(octet_length(ops) AS BIGINT) AS b))), named_struct('n', 1L, 'size', 2L, 'items', 0L),
        (acc, x) -> IF(acc.items > 0 AND acc.size + x.b + 1 > 500, named_struct('n', acc.n + 1, 'size', 2 + x.b, 'items', 1L), named_struct('n', acc.n, 'size', acc.size + x.b + IF(acc.items > 0, 1, 0), 'items', acc.items + 1))) AS acc FROM changelog GROUP BY doc_id) f""",
    """SELECT doc_id, acc.n AS batches, acc.size AS last_bytes FROM (SELECT doc_id, list_reduce(list({'n': 0::BIGINT, 'size': strlen(ops)::BIGINT, 'items': 0::BIGINT} ORDER BY rev), lambda acc, x:
        CASE WHEN acc.items > 0 AND acc.size + x.size + 1 > 500 THEN {'n': acc.n + 1, 'size': 2 + x.size, 'items': 1::BIGINT} ELSE {'n': acc.n, 'size': acc.size + x.size + CASE WHEN acc.items > 0 THEN 1 ELSE 0 END, 'items': acc.items + 1} END,
        {'n': 1::BIGINT, 'size': 2::BIGINT, 'items': 0::BIGINT}) AS acc FROM changelog GROUP BY doc_id) f""",
)
add("split_rev_shift", "SELECT doc_id, rev, rev + coalesce(sum(CAST(ceil({LEN}(ops) / 45.0) AS BIGINT) - 1) OVER (PARTITION BY doc_id ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_rev FROM changelog")

# --- the flat engine (K1, K3, K7, K8) ---------------------------------------------------------------
add("micro_merge_set", "SELECT doc_id, path, max_by(value, struct(ts, seq)) AS value FROM oplog WHERE op = 'replace' GROUP BY doc_id, path", "SELECT doc_id, path, arg_max(value, row(ts, seq)) AS value FROM oplog WHERE op = 'replace' GROUP BY doc_id, path")
add("micro_surviving_children", "SELECT DISTINCT c.doc_id, c.path, c.seq FROM treelog c LEFT ANTI JOIN treelog p ON c.doc_id = p.doc_id AND startswith(c.path, concat(p.path, '/')) AND c.ts <= p.ts", "SELECT c.doc_id, c.path, c.seq FROM treelog c WHERE NOT EXISTS (SELECT 1 FROM treelog p WHERE c.doc_id = p.doc_id AND starts_with(c.path, p.path || '/') AND c.ts <= p.ts)")
add("micro_changes_since", "SELECT o.doc_id, o.path, o.seq FROM oplog o LEFT ANTI JOIN (SELECT doc_id, path FROM oplog WHERE op = 'remove' AND seq > 50) d ON o.doc_id = d.doc_id AND o.path = d.path WHERE o.seq > 30", "SELECT o.doc_id, o.path, o.seq FROM oplog o WHERE o.seq > 30 AND NOT EXISTS (SELECT 1 FROM oplog d WHERE d.op = 'remove' AND d.seq > 50 AND o.doc_id = d.doc_id AND o.path = d.path)")
add("micro_prune", "SELECT doc_id, count(*) AS kept FROM oplog WHERE ts >= 1705000000000 AND substr(op, 1, 1) = '@' GROUP BY doc_id")

# --- layers and gaps (L) ---------------------------------------------------------------------------
add("layered_read", """SELECT doc_id, path, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY layer DESC, seq DESC) AS r FROM (
        SELECT doc_id, path, value, seq, CASE WHEN seq <= 20 THEN 0 WHEN seq <= 35 THEN 1 WHEN seq <= 45 THEN 2 ELSE 3 END AS layer FROM oplog WHERE op = 'replace') x) y WHERE r = 1""")
add("pure_echo", "SELECT doc_id, count(CASE WHEN known IS NULL THEN 1 END) = 0 AS echo FROM (SELECT a.doc_id, b.id AS known FROM oplog a LEFT JOIN (SELECT doc_id, path, value, min(id) AS id FROM oplog WHERE seq <= 40 GROUP BY doc_id, path, value) b ON a.doc_id = b.doc_id AND a.path = b.path AND a.value = b.value WHERE a.seq BETWEEN 10 AND 42) x GROUP BY doc_id")
add("withheld_rows", "SELECT p.doc_id, p.rev FROM changelog p LEFT ANTI JOIN (SELECT doc_id, id FROM changelog WHERE id % 13 <> 0) s ON p.doc_id = s.doc_id AND p.id = s.id WHERE p.rev <= 30", "SELECT doc_id, rev FROM changelog WHERE id % 13 = 0 AND rev <= 30")
add("gap_report", "SELECT doc_id, count(*) AS gaps FROM (SELECT doc_id, rev, lag(rev, 1, 0) OVER (PARTITION BY doc_id ORDER BY rev) AS cursor_rev FROM received) x WHERE rev > cursor_rev + 1 GROUP BY doc_id",
    "SELECT doc_id, count(*) AS gaps FROM received r WHERE r.rev > 1 AND NOT EXISTS (SELECT 1 FROM received p WHERE p.doc_id = r.doc_id AND p.rev = r.rev - 1) GROUP BY doc_id")
add("pending_prefix", "SELECT doc_id, path, seq FROM treelog WHERE path = '/s1' OR (path > '/s1/' AND path < '/s10')")

# --- delivery (M) ----------------------------------------------------------------------------------
_SUBS = "(SELECT DISTINCT client_id, doc_id FROM changelog WHERE rev <= 5)"
add("broadcast", f"SELECT s.client_id, c.doc_id, c.rev FROM changelog c JOIN {_SUBS} s ON c.doc_id = s.doc_id WHERE s.client_id <> c.client_id AND c.rev > 5")
# numbers every event that broadcast sends
add("client_event_log", f"SELECT s.client_id, c.doc_id, c.rev, row_number() OVER (PARTITION BY s.client_id ORDER BY c.created_at, c.id) AS event_no FROM changelog c JOIN {_SUBS} s ON c.doc_id = s.doc_id WHERE s.client_id <> c.client_id AND c.rev > 5")
add("cursor_replay", """SELECT client_id, asked, CASE WHEN asked IS NULL OR asked >= next_no THEN 'resync' ELSE 'replay' END AS status FROM (
        SELECT client_id, CASE client_id WHEN 'c0' THEN 10 WHEN 'c1' THEN 1000000000 END AS asked, count(*) + 1 AS next_no FROM changelog GROUP BY client_id) x""")
add("retention_trim", "SELECT client_id, count(*) AS kept FROM changelog WHERE created_at >= 1705500000000 GROUP BY client_id")
add("subscriptions", "SELECT client_id, doc_id FROM (SELECT client_id, doc_id, max_by(k % 2, rev) AS last FROM changelog GROUP BY client_id, doc_id) x WHERE last = 1", "SELECT client_id, doc_id FROM (SELECT client_id, doc_id, arg_max(k % 2, rev) AS last FROM changelog GROUP BY client_id, doc_id) x WHERE last = 1")
add("presence", "SELECT client_id, doc_id, state FROM (SELECT client_id, doc_id, max_by(path, rev) AS state, max_by(k % 9, rev) AS gone FROM changelog GROUP BY client_id, doc_id) x WHERE gone <> 0", "SELECT client_id, doc_id, state FROM (SELECT client_id, doc_id, arg_max(path, rev) AS state, arg_max(k % 9, rev) AS gone FROM changelog GROUP BY client_id, doc_id) x WHERE gone <> 0")
add("arrival_gaps", "SELECT doc_id, count(CASE WHEN rev <= seen THEN 1 END) AS late, count(CASE WHEN rev > seen + 1 THEN 1 END) AS ahead FROM (SELECT doc_id, rev, max(rev) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM changelog) x GROUP BY doc_id")
