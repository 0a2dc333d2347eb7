"""Change logs as views of the tables: pure functions of one table with a total order (doc_id, seq).

Each view exists in the two dialects, Spark's and DuckDB's, so that a query and its oracle start from the same rows.
`LOGS` has the views by name; `with_logs` puts those that a statement names before it.
"""

from __future__ import annotations

import re

#: dialect -> what differs: a JSON number, milliseconds of a time, a table's rows
DIALECT = {
    "spark": {"K": "CAST(get_json_object(props, '$.k') AS BIGINT)", "MS": "unix_millis(CAST(ts AS TIMESTAMP))", "LEN": "octet_length", "SHIPPED": "unix_millis(CAST(l_shipdate AS TIMESTAMP))"},
    "duckdb": {"K": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "MS": "epoch_us(ts) // 1000", "LEN": "strlen", "SHIPPED": "epoch_us(l_shipdate) // 1000"},
}

LOGS = {
    "log0": """SELECT event_id, user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type,
        {K} AS k, {MS} AS created_at FROM events""",
    "oplog": """SELECT doc_id, seq, event_id AS id, concat('/f', CAST(k % 8 AS STRING)) AS path,
        CASE event_type WHEN 'signup' THEN 'replace' WHEN 'purchase' THEN '@inc' WHEN 'error' THEN 'remove' WHEN 'view' THEN '@max' ELSE '@min' END AS op,
        k AS value, created_at - (event_id % 7) * 3600000 AS ts, created_at FROM log0""",
    "setlog": "SELECT * FROM oplog WHERE op IN ('replace', 'remove')",
    "setseq": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS seq, path, op, value FROM setlog",
    "treelog": """SELECT doc_id, seq, event_id AS id, concat('/s', CAST(k % 4 AS STRING), CASE k % 3 WHEN 0 THEN '' ELSE concat('/c', CAST(k % 5 AS STRING)) END) AS path,
        CASE WHEN event_type = 'error' THEN 'remove' ELSE 'replace' END AS op, k AS value, created_at - (event_id % 7) * 3600000 AS ts FROM log0""",
    "changelog": """SELECT doc_id, seq AS rev, seq - 1 AS base_rev, event_id AS id, created_at, concat('c', CAST(event_id % 3 AS STRING)) AS client_id,
        concat('b', CAST(event_id % 50 AS STRING)) AS batch_id, k, concat('/f', CAST(k % 8 AS STRING)) AS path,
        concat('[{"op":"replace","path":"/f', CAST(k % 8 AS STRING), '","value":', CAST(k AS STRING), '}]') AS ops FROM log0""",
    "concurrent": "SELECT *, greatest(0, rev - 1 - (id % 4)) AS sent_base FROM changelog",
    "resent": "SELECT *, 1 AS copy FROM changelog UNION ALL SELECT *, 2 AS copy FROM changelog WHERE id % 9 = 0",
    "received": "SELECT * FROM changelog WHERE id % 13 <> 0",
    "sessions": """SELECT *, sum(CASE WHEN prev IS NULL OR created_at - prev > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
        FROM (SELECT *, lag(created_at) OVER (PARTITION BY doc_id ORDER BY rev) AS prev FROM changelog) x""",
    "versions": """SELECT doc_id, session AS version, min(rev) AS start_rev, max(rev) AS end_rev, min(created_at) AS started_at, max(created_at) AS ended_at,
        CASE WHEN session % 5 = 0 THEN 'offline-branch' ELSE 'main' END AS origin FROM sessions GROUP BY doc_id, session""",
    "tips": "SELECT doc_id, max(rev) AS tip FROM changelog GROUP BY doc_id",
    "branches": """SELECT doc_id, CAST(floor(tip / 2) AS BIGINT) AS branched_at, CASE WHEN doc_id % 20 = 0 THEN CAST(floor(tip / 2) AS BIGINT) + 3 END AS merge_base, tip,
        doc_id % 30 = 0 AS deleted, tip * 1000 AS modified_at FROM tips WHERE doc_id % 10 = 0""",
    "tombstones": "SELECT doc_id, tip AS last_rev, tip * 1000 AS expires_at FROM tips WHERE doc_id % 7 = 0",
    "multiwriter": """SELECT l_orderkey AS doc_id, l_linenumber AS field, {SHIPPED} AS ts, CAST(round(l_quantity * 100) AS BIGINT) AS quantity, l_partkey, l_suppkey,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_returnflag, l_linestatus, CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem""",
    "textlog": "SELECT conv_id AS doc_id, turn AS seq, role AS client_id, text FROM conversations",
}

TABLES = ("events", "lineitem", "conversations", "orders")


def _needed(sql: str) -> list[str]:
    found: list[str] = []

    def visit(text: str) -> None:
        for name in LOGS:
            if re.search(rf"\b{name}\b", text) and name not in found:
                visit(LOGS[name])
                found.append(name)

    visit(sql)
    return found


def with_logs(sql: str, dialect: str) -> str:
    """The statement in a dialect, with the views that it names before it. {WORDS} are the dialect's."""
    views = [f"{n} AS ({LOGS[n]})" for n in _needed(sql)]
    head, _, body = sql.strip().rpartition("\n;\n")
    parts = views + ([head] if head else [])
    text = (f"WITH {', '.join(parts)}\n" if parts else "") + body
    for k, v in DIALECT[dialect].items():
        text = text.replace("{" + k + "}", v)
    return re.sub(r"\bAS STRING\)", "AS VARCHAR)", text) if dialect == "duckdb" else text


def spark_statement(sql: str, sf_dir: str) -> str:
    """A Spark statement over the parquet tables of a folder."""
    text = with_logs(sql, "spark")
    for t in TABLES:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet` AS {t}", text)
    return text
