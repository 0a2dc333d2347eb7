import random

import pytest

from revloom.kernels import delta, fields, ordering, patch


def test_apply_and_containers():
    assert patch.apply({}, [{"op": "add", "path": "/obj/0/0/foo", "value": "bar"}]) == {"obj": [[{"foo": "bar"}]]}
    assert patch.apply({"a": 1}, [{"op": "test", "path": "/a", "value": 2}, {"op": "remove", "path": "/a"}]) == {"a": 1}
    assert patch.apply({"a": [1, 2]}, [{"op": "add", "path": "/a/-", "value": 3}, {"op": "move", "from": "/a/0", "path": "/a/2"}]) == {"a": [2, 3, 1]}
    with pytest.raises(patch.PatchError):
        patch.apply({"a": [1]}, [{"op": "remove", "path": "/a/4"}], strict=True)


def test_compose_sums_and_text():
    assert patch.compose([{"op": "@inc", "path": "/x", "value": v} for v in (4, 2, -10, 20)]) == [{"op": "@inc", "path": "/x", "value": 16}]
    assert delta.plain(delta.apply_text([{"insert": "abc\n"}], [{"retain": 10}, {"insert": "X"}])) == "abc\nX\n"
    assert delta.transform([{"insert": "test"}], [{"insert": "testing"}], True) == [{"retain": 4}, {"insert": "testing"}]


def test_text_converges_and_inverts():
    rng = random.Random(4)
    for _ in range(300):
        base = [{"insert": "".join(rng.choice("abé😀") for _ in range(rng.randint(1, 9))) + "\n"}]

        def change():
            at = rng.randint(0, sum(map(delta.length, base)) - 1)
            left = sum(map(delta.length, base)) - 1 - at
            return delta.chop([op for op in ([{"retain": at}] if at else []) + [{"insert": rng.choice("xyz")}] + ([{"delete": rng.randint(1, left)}] if left and rng.random() < 0.5 else [])])

        a, b = change(), change()
        assert delta.compose(delta.compose(base, a), delta.transform(a, b, True)) == delta.compose(delta.compose(base, b), delta.transform(b, a, False))
        assert delta.compose(delta.compose(base, a), delta.invert(a, base)) == base


def test_fields():
    assert fields.resolve({"op": "@inc", "path": "/a", "value": 5, "ts": 1000}, {"op": "@inc", "path": "/a", "value": 3, "ts": 2000}) == {"op": "@inc", "path": "/a", "value": 8, "ts": 2000}
    rows = fields.commit_all([{"op": "replace", "path": "/a", "value": 1, "ts": 1}, {"op": "replace", "path": "/a/b", "value": 2, "ts": 2}])
    assert list(rows) == ["/a"]
    assert fields.flat_merge({"op": "=", "val": 5, "ts": 1}, {"op": "+", "val": 1, "ts": 2})["val"] == 6


def test_order_keys():
    assert ordering.between(None, None) == "a0"
    rng, keys = random.Random(2), ["a0"]
    for _ in range(500):
        i = rng.randint(0, len(keys))
        keys.insert(i, ordering.between(keys[i - 1] if i else None, keys[i] if i < len(keys) else None))
    assert keys == sorted(set(keys))
    assert ordering.heal([("x", "a1"), ("y", "a1")]).keys() == {"y"}


def test_fields_against_a_plain_table():
    """The tree against a list of rows that is searched whole for every op."""
    rng = random.Random(6)
    for _ in range(200):
        ops = []
        for t in range(rng.randrange(1, 40)):
            path = "/" + "/".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
            kind = rng.choice(["replace", "replace", "remove", "@inc", "@max"])
            ops.append({"op": kind, "path": path, "ts": rng.randrange(20)} | ({} if kind == "remove" else {"value": rng.choice([1, 2, {}]) if kind == "replace" else rng.randrange(9)}))
        ops = [o for o in ops if not (o["op"][0] == "@" and any(p["path"] == o["path"] and p.get("value") == {} for p in ops))]
        rows = {}
        for op in ops:
            over = [p for p in rows if op["path"].startswith(p + "/")]
            if any(rows[p]["op"] != "remove" and not isinstance(rows[p]["value"], dict) for p in over):
                continue
            rows = {p: r for p, r in rows.items() if p not in over or r["op"] != "remove"}
            won = fields.resolve(rows[op["path"]], op) if op["path"] in rows else op
            if won is not None:
                rows = {p: r for p, r in rows.items() if not p.startswith(op["path"] + "/")} | {op["path"]: won}
        assert fields.commit_all(ops) == rows


def test_commits_of_fields():
    d = fields.Document()
    assert d.commit({"id": 1, "ops": [{"op": "replace", "path": "/a", "value": 5, "ts": 10}, {"op": "@inc", "path": "/n", "value": 2}], "created_at": 10, "base_rev": 0}, 100) and d.rev == 1
    assert [r["value"] for r in d.commit({"id": 1, "ops": [{"op": "@inc", "path": "/n", "value": 2}], "base_rev": 1}, 100)] == [2] and d.rev == 1
    told = d.commit({"id": 2, "ops": [{"op": "replace", "path": "/a", "value": 6, "ts": 3}], "base_rev": 1}, 100)
    assert [(r["path"], r["value"], r["rev"]) for r in told] == [("/a", 5, 1)] and d.rev == 1
    assert [(r["path"], r["ts"]) for r in d.commit({"id": 3, "ops": [{"op": "replace", "path": "/b", "value": 1, "ts": 900}], "base_rev": 1}, 200)] == [("/b", 200)] and d.rev == 2
    assert [r["path"] for r in d.commit({"id": 4, "ops": [{"op": "replace", "path": "/a/x", "value": 1, "ts": 300}], "base_rev": 2}, 300)] == ["/a"] and d.rev == 2


def test_pending_texts_and_lists():
    text = lambda at, s: [*([{"retain": at}] if at else []), {"insert": s}]
    p = fields.flat_pending({"t": {"op": "#", "val": text(0, "ab"), "ts": 1}}, {"t": {"op": "#", "val": text(2, "c"), "ts": 2}})
    assert p["t"]["op"] == "#" and p["t"]["val"] == [{"insert": "abc"}]
    p = fields.flat_pending({"t": {"op": "=", "val": [{"insert": "x\n"}], "ts": 1}}, {"t": {"op": "#", "val": text(1, "y"), "ts": 2}})
    assert p["t"]["op"] == "=" and delta.plain(p["t"]["val"]) == "xy\n"
    assert fields.flat_pending({"n": {"op": "=", "val": 3, "ts": 1}}, {"n": {"op": "^", "val": 2, "ts": 2}})["n"]["val"] == 3
    stored = {"a": [1, {"b": 2}], "o": {"k": 1}}
    assert fields.flat_state(stored | {"a.1.b": 5, "o.j": 2, "s": 1, "s.x": 2}) == {"a": [1, {"b": 5}], "o": {"k": 1, "j": 2}, "s": {"x": 2}} and stored == {"a": [1, {"b": 2}], "o": {"k": 1}}


def test_commits_of_flat_fields():
    d = fields.FlatDocument()
    d.commit(1, {"a.b": {"op": "=", "val": 1, "ts": 5}, "a.c": {"op": "=", "val": 2, "ts": 9}})
    assert d.commit(2, {"a": {"op": "!", "val": None, "ts": 7}}).keys() == {"a", "a.b"} and d.fields["a.b"]["op"] == "!" and d.fields["a.c"]["val"] == 2
    assert d.rev == 2 and d.commit(2, {"a": {"op": "=", "val": 0, "ts": 99}}).keys() == {"a", "a.b"} and d.rev == 2
    assert d.commit(3, {"a.c": {"op": "=", "val": 0, "ts": 1}}) == {} and d.rev == 2
    assert d.effective({"n": {"op": "+", "val": 2, "ts": 10}}, {"n": {"op": "+", "val": 3, "ts": 11}})["n"]["val"] == 5


def test_text_commits_inside_a_compacted_range():
    from revloom.kernels import textlog

    log = [(r, [{"insert": str(r)}]) for r in range(1, 6)]
    assert textlog.guarded(textlog.compact(log, 3), [(1, 3)], 3, [{"insert": "x"}]) == [{"retain": 2}, {"insert": "x"}]
    with pytest.raises(textlog.Compacted):
        textlog.guarded(textlog.compact(log, 3), [(1, 3)], 2, [{"insert": "x"}])


def test_long_texts_in_linear_time():
    import time

    began, text = time.time(), [{"insert": "\n"}]
    for i in range(400):
        text = delta.apply_text(text, [*([{"retain": 20 * i}] if i else []), {"insert": "a turn of this text\n"}])
    assert time.time() - began < 0.2 and delta.length(text[0]) == 8001
