import os

import pytest

from revloom.streaming import commits, flows

SCHEMA = "doc_id long, id long, rev long, path string, op string, value long, ts long, client_id string, at timestamp"


def run(frame, mode, tmp_path, name):
    frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
    return frame.sparkSession.table(name).collect()


def test_flows(spark, tmp_path):
    rows = "SELECT id % 3 AS doc_id, id % 20 AS id, id AS rev, concat('/f', id % 2) AS path, CASE WHEN id % 5 = 0 THEN '@inc' ELSE 'replace' END AS op, id AS value, 1000 - id AS ts, concat('c', id % 2) AS client_id, timestamp_seconds(1000000 + id) AS at FROM range(25)"
    spark.sql(rows).repartition(2).write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name in ("fields", "deltas"):
        assert sorted(run(getattr(flows, name)(changes), "complete", tmp_path, name)) == sorted(getattr(flows, name)(table).collect())
    subs = spark.createDataFrame([("c0", 0), ("c1", 0), ("c1", 1)], "client_id string, doc_id long")
    assert sorted(run(flows.broadcast(changes, subs), "append", tmp_path, "sent")) == sorted(flows.broadcast(table, subs).collect())
    seen = run(flows.once(changes), "append", tmp_path, "seen")
    assert len(seen) == len({(r.doc_id, r.id) for r in seen}) == table.select("doc_id", "id").distinct().count()
    assert all(r.n > 0 for r in run(flows.versions(changes), "append", tmp_path, "sessions"))


@pytest.mark.parametrize("kind", sorted(commits.KINDS))
def test_commits_like_their_twin(spark, tmp_path, kind):
    ops = {
        "fields": """concat('[{"op":"', IF(id % 7 = 0, 'remove', 'replace'), '","path":"/a', id % 4, IF(id % 3 = 0, '', '/b'), '","value":', id, ',"ts":', 1000 + id * 37 % 50, '}]')""",
        "flat": """concat('{"a', id % 4, IF(id % 3 = 0, '', '.b'), '":{"op":"', IF(id % 7 = 0, '!', '='), '","val":', id, ',"ts":', 1000 + id * 37 % 50, '}}')""",
        "ops": """concat('[{"op":"add","path":"/l/0","value":', id, '}]')""",
    }[kind]
    for part in range(3):  # one file a micro-batch, and a change of the part before sent once more
        spark.sql(f"SELECT id % 3 AS doc_id, id, id + 1 AS seq, {ops} AS ops, 5000 + id AS at, greatest(0, id DIV 3 - 2) AS base_rev FROM range({max(0, part * 20 - 4)}, {part * 20 + 20})").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{part}"))
    files = [next((tmp_path / f"in{part}").glob("*.parquet")) for part in range(3)]
    (tmp_path / "in").mkdir()
    for part, f in enumerate(files):
        (tmp_path / "in" / f"{part}.parquet").write_bytes(f.read_bytes())
        os.utime(tmp_path / "in" / f"{part}.parquet", (1000 + part, 1000 + part))
    schema = "doc_id long, id long, seq long, ops string, at long, base_rev long"
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run(commits.stream(changes, commits.KINDS[kind]), "append", tmp_path, f"commits_{kind}")
    assert {r.status for r in out} >= {"committed", "known"} and len(out) == 68
    whole = spark.read.schema(schema).parquet(str(tmp_path / "in")).dropDuplicates(["doc_id", "id"])
    twin = commits.table(whole, commits.KINDS[kind]).collect()
    assert sorted((r.doc_id, r.id, r.rev, r.status, r.ops) for r in out if r.status != "known") == sorted(tuple(r) for r in twin)
    if kind == "ops":
        assert sorted((r.doc_id, r.rev) for r in twin) == sorted((i % 3, i // 3 + 1) for i in range(60))


def test_old_and_early_bases():
    log = commits.Held()
    say = lambda i, base: commits.OpCommits.commit(log, {"id": i, "base_rev": base, "ops": '[{"op":"replace","path":"/a","value":1}]'})[1]
    assert [say(1, 0), say(2, 5), say(1, 0)] == ["committed", "reload", "known"]
    say(3, 1)
    log.trim(1)
    assert [say(4, 0), say(5, 1)] == ["reload", "committed"]
    assert commits.Held.load(log.dump()).changes == log.changes
