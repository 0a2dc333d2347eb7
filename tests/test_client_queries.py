import json
import random

import duckdb
import pytest

from revloom.kernels import branching, builder, lz, patch, textlog, transform
from revloom.plans import client_queries

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    k = sorted(frame.columns)
    return sorted(map(tuple, frame[k].astype(object).where(frame[k].notna(), None).astype(str).replace(r"\.0$", "", regex=True).values.tolist()))


@pytest.mark.parametrize("name", sorted(client_queries.ORACLES))
def test_same_as_oracle(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert rows(client_queries.QUERIES[name](spark, FOLDER).toPandas()) == rows(con.sql(client_queries.ORACLES[name]).df())


def test_stored_sizes(spark):
    out = client_queries.QUERIES["stored_sizes"](spark, FOLDER).toPandas()
    for r, n, b in out[["rev", "base64", "bytes"]].head(50).values.tolist():
        assert n > len(f'{{"rev":{r},"ops":""}}') and (n - len(f'{{"rev":{r},"ops":""}}')) % 4 == 0 and b > len(f'{{"rev":{r}}}')
    data = {"rev": 3, "ops": [{"op": "add", "path": "/ä", "value": "aaaaaaaaaaaaaaaa"}], "note": "é"}
    packed = lz.to_base64(json.dumps(data["ops"], separators=(",", ":"), ensure_ascii=False))
    assert json.loads(lz.from_base64(packed)) == data["ops"]
    assert builder.stored_size(data) == len(f'{{"rev":3,"ops":"{packed}","note":"é"}}'.encode()) and builder.stored_size(None) == 0
    assert builder.stored_size("x") == len(lz.to_base64('"x"')) and builder.stored_size("x", "bytes") == len(lz.to_bytes('"x"'))


def change(i, *ops, base=0, rev=0):
    return {"id": i, "base_rev": base, "rev": rev, "ops": list(ops)}


def put(i):
    return {"op": "add", "path": "/l/0", "value": i}


def test_windows_of_a_merge():
    source = [change(i, put(i), rev=i) for i in range(1, 6)]
    branch = [change(100 + i, put(100 + i)) for i in range(5)]
    windows = list(branching.merge(source, 2, branch, most=2))
    assert [[c["rev"] for c in w] for w in windows] == [[6, 7], [8, 9], [10]]
    assert [len(w) for w in branching.merge(source, 2, branch, most_bytes=1)] == [1] * 5
    with pytest.raises(branching.Gap):
        list(branching.merge(source[:3] + source[4:], 2, branch))
    # what a first merge committed comes back as an echo, and only the rest is merged
    again = list(branching.merge(source + windows[0], 2, branch))
    assert [[(c["id"], c["rev"]) for c in w] for w in again] == [[(102, 8), (103, 9), (104, 10)]]


def test_merging_in_parts_is_merging_at_once():
    r = random.Random(1)
    for _ in range(50):
        state, log, branch = {"l": [0, 1, 2]}, [], []
        here = there = state
        for i in range(6):
            for rows_, side in ((log, 0), (branch, 1)):
                now = there if side else here
                n = len(now["l"])
                op = {"op": "add", "path": f"/l/{r.randint(0, n)}", "value": f"{side}{i}"} if r.random() < 0.7 or not n else {"op": "remove", "path": f"/l/{r.randrange(n)}"}
                now = patch.apply(now, [op], strict=True)
                if side:
                    there = now
                else:
                    here = now
                rows_.append(change(f"{side}.{i}", op, rev=i + 1))
        ends = []
        for most in (1, 100):
            whole = log + [c for w in branching.merge(log, 0, branch, most) for c in w]
            end = state
            for c in whole:
                end = patch.apply(end, c["ops"], strict=True)
            ends.append(end)
        part = log + [c for w in branching.merge(log, 0, branch[:3]) for c in w]
        part += [c for w in branching.merge(part, 0, branch) for c in w]
        end = state
        for c in part:
            end = patch.apply(end, c["ops"], strict=True)
        assert ends[0] == ends[1] == end


def test_queue_with_debt():
    committed = [change(9, put(9), rev=5), change(1, put(1), rev=6)]
    queue = [change(1, put(1), base=4, rev=5), change(2, put(2), base=3, rev=6), change(3, {"op": "add", "path": "/l/1", "value": 3}, base=4, rev=7)]
    out = branching.rebase_indebted(committed, queue, 4)
    assert [(q["id"], q["base_rev"], q["rev"]) for q in out] == [(2, 3, 7), (3, 6, 8)]
    assert out[0]["ops"] == [put(2)]
    assert branching.rebase_indebted([], queue, 4) == queue
    whole = [q for q in queue if q["id"] != 2]
    assert branching.rebase_indebted(committed, whole, 4) == transform.rebase(committed, whole)


def test_probe():
    queue = [change(1, {"op": "copy", "from": "/x", "path": "/y"}), change(2, {"op": "copy", "from": "/z", "path": "/y"}), change(3, {"op": "add", "path": "/a", "value": 1})]
    assert branching.applies({"x": 1}, queue, 1) and not branching.applies({"x": 1}, queue, 2)
    assert branching.applies({"x": 1}, queue, 3) and branching.applies({}, queue, 4)


def test_failures_count_once_before_a_reload():
    f = branching.Failures()
    assert [f.failed(1), f.failed(1), f.failed(1)] == [False] * 3
    f.reload()
    assert f.count[1] == 1 and f.failed(1) and f.floored(1)
    f.reload()
    assert f.floored(1)


def test_swap():
    assert branching.swap({"merged": 3}, {}, {"merged": None}) == {"merged": 3}
    assert branching.swap({"merged": 3}, {"merged": 1}, {"merged": None}) is None
    assert branching.swap({"merged": 3}, {"merged": 1}, {}) == branching.swap({"merged": 3}, {"merged": 1}, {"merged": 1}) == {"merged": 3}


def test_builder():
    p = builder.Pointer()
    ops = builder.Ops().add(p.items[0]["a/b"], 1).replace("x").increment("n").decrement("n", 2).bit("b", 1, True).updates({"u": None, "v~": 2}, "/q").move("/a", "/a").copy("/a", "/c")
    assert [o["op"] for o in ops.ops] == ["add", "remove", "@inc", "@inc", "@bit", "remove", "replace", "copy"]
    assert ops.ops[0]["path"] == "/items/0/a~1b" and ops.ops[6]["path"] == "/q/v~0" and ops.ops[3]["value"] == -2
    assert builder.Ops.from_json(ops.to_json()).ops == ops.ops
    assert builder.build(lambda o, root: o.add(root.t, 1)) == [{"op": "add", "path": "/t", "value": 1}]
    state = {"n": 1}
    two = builder.Ops().increment("n").concat(builder.Ops().increment("n", 2))
    done = two.apply(state)
    assert done == {"n": 4} and two.invert(state).apply(done) == state and two.compose().apply(state) == done
    with pytest.raises(AttributeError):
        p.x = 1
    row = builder.change(3, 4, ops.ops, 99)
    assert builder.is_pending(row) and row["id"].startswith("4-") and "rev" not in builder.change_input([], 1)


def test_held_text():
    held = textlog.Held(3, [{"retain": 2}, {"insert": "s"}], [{"retain": 3}, {"insert": "p"}])
    assert held.receive(3, [{"insert": "old"}]) is None and not held.lost
    assert held.receive(4, [{"insert": "ab"}]) == [{"insert": "ab"}]
    assert held.sending == [{"retain": 4}, {"insert": "s"}] and held.pending == [{"retain": 5}, {"insert": "p"}]
    assert held.receive(6, [{"insert": "x"}]) is None and held.lost and held.rev == 4
    held.resync(6, [(5, [{"insert": "own"}]), (6, [{"insert": "z"}])], own=5)
    assert held.rev == 6 and not held.lost and held.sending == [{"retain": 5}, {"insert": "s"}]
