import duckdb
import pytest

from revloom.plans import registry
from revloom.sources.logs import with_logs

FOLDER = "/root/testdata/sf0.001"
SOME = ["lww_set_fields", "lww_consolidate_fields", "lww_server_local_merge", "bitmask_fold", "sessions_versions", "latest_main_version", "version_parents", "greedy_batches", "compose_runs", "micro_surviving_children", "cursor_replay", "replay_flat", "text_replay", "ot_commit", "ot_commit_list", "ot_commit_text", "ot_rebase", "ot_eject", "lz_round_trip", "text_log", "invert_flat", "frame_prefix", "dedup_batch", "tail_after_version", "append_violations", "gap_report", "client_event_log", "ancestors", "lww_parent_shield", "lww_commit", "document_now", "document_states", "states_before_versions", "micro_commit", "oversized_ops", "compose_runs"]


def rows(frame):
    k = sorted(frame.columns)
    return sorted(map(tuple, frame[k].astype(object).where(frame[k].notna(), None).astype(str).replace(r"\.0$", "", regex=True).values.tolist()))


@pytest.mark.parametrize("name", SOME)
def test_same_as_oracle(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())


def test_undo_and_compose(spark):
    out = registry.QUERIES["invert_and_compose"](spark, FOLDER).toPandas()
    assert len(out) and out["undone"].all() and out["composed_alike"].all()


def test_split_and_guard(spark):
    out = registry.QUERIES["split_changes"](spark, FOLDER).toPandas()
    want = {r.doc_id: r.body for r in registry.QUERIES["text_replay"](spark, FOLDER).collect()}
    assert (out["oversized"] == 0).all() and (out["pieces"] >= out["changes"]).all() and dict(zip(out["doc_id"], out["body"])) == want
    told = registry.QUERIES["merge_guard"](spark, FOLDER).toPandas()
    assert told["duplicated"].any() and not told["duplicated"].all()


def test_whole_logs(spark):
    """Every revision takes part: against loops over the log in Python."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    names = ("doc_id", "rev", "id", "client_id", "path", "created_at")
    logs, versions = {}, {}
    for row in con.sql(with_logs(f"SELECT {', '.join(names)} FROM changelog ORDER BY doc_id, rev", "duckdb")).fetchall():
        logs.setdefault(row[0], []).append(dict(zip(names, row)))
    for doc, version, end in con.sql(with_logs("SELECT doc_id, version, end_rev FROM versions WHERE origin = 'main'", "duckdb")).fetchall():
        versions.setdefault(doc, []).append((end, version))
    assert all(len(log) > 30 for log in logs.values())

    def got(name, *columns):
        return sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, FOLDER).collect())

    # a queued write of the same field is later, so the foreign one is lost
    kept = {d: sum(r["id"] % 2 == 1 and r["path"] not in {q["path"] for q in log if q["id"] % 2 == 0} for r in log) for d, log in logs.items()}
    assert got("frame_advance", "doc_id", "programs", "n_ops") == sorted((d, n, n) for d, n in kept.items())
    assert got("ot_eject", "doc_id", "rev", "id") == sorted((d, n, i) for d, log in logs.items() for n, i in enumerate([r["id"] for r in log if r["rev"] != 3], 1))
    as_of = sorted((d, r["rev"], max([v for e, v in versions.get(d, []) if e <= r["rev"]], default=0)) for d, log in logs.items() for r in log)
    assert [(d, r, v) for d, r, v, kind in sorted((d, r, v or 0, k) for d, r, v, k in ((x.doc_id, x.rev, x.version, x.kind) for x in registry.QUERIES["latest_main_version"](spark, FOLDER).collect())) if kind == 1] == as_of
    sent = {}
    for d, log in logs.items():
        for client in {r["client_id"] for r in log if r["rev"] <= 5}:
            sent.setdefault(client, []).extend((r["created_at"], r["id"], d, r["rev"]) for r in log if r["client_id"] != client and r["rev"] > 5)
    assert got("client_event_log", "client_id", "event_no", "doc_id", "rev") == sorted((c, n, d, r) for c, rows in sent.items() for n, (_, _, d, r) in enumerate(sorted(rows), 1))



def test_states_read_the_tail_alone(spark):
    """A state asked of a document reads its log behind the snapshot, and no earlier revisions decide it."""
    from revloom.operators import history

    log = spark.createDataFrame([(1, r, f"/f{r % 3}", "remove" if r % 7 == 0 else "replace", r) for r in range(1, 104)], "doc_id long, rev long, path string, op string, value long")
    snaps = history.snapshots(log, 25).cache()
    for at in (1, 24, 25, 26, 49, 50, 103):
        want = {}
        for r in range(1, at + 1):
            want[f"/f{r % 3}"] = None if r % 7 == 0 else r
        got = history.states(log.where(f"rev > {at // 25 * 25}"), snaps, spark.createDataFrame([(1, at)], "doc_id long, at long"), 25).collect()
        assert {r.path: r.value for r in got} == {p: v for p, v in want.items() if v is not None}


def test_groups_of_a_stream():
    import pandas as pd

    from revloom.plans.kernel_queries import groups_of

    keys = [1, 1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    for size in (1, 2, 3, 4, 11):
        frames = [pd.DataFrame({"k": keys[i : i + size], "v": range(i, min(len(keys), i + size))}) for i in range(0, len(keys), size)]
        got = [(k, p["v"].tolist()) for (k,), p in groups_of(iter(frames), ["k"])]
        assert got == [(1, [0, 1, 2]), (2, [3]), (3, [4, 5, 6, 7]), (4, [8]), (5, [9, 10])]
    assert list(groups_of(iter([]), ["k"])) == []
