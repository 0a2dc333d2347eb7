import pytest

from revloom.kernels import client


def change(i, rev, path, value, base=0, op="add"):
    return {"id": i, "rev": rev, "base_rev": base, "ops": [{"op": op, "path": path, "value": value}]}


def test_receive():
    mine = [change("p", 1, "/l/0", "p"), change("q", 2, "/l/1", "q")]
    state, rev, left = client.receive({"l": []}, 0, mine, [change("a", 1, "/l/0", "a"), change("p", 2, "/l/1", "p")])
    assert state == {"l": ["a", "p"]} and rev == 2 and [(c["id"], c["rev"], c["base_rev"]) for c in left] == [("q", 3, 2)]
    assert client.view(state, rev, left)["l"].count("q") == 1
    assert client.receive(state, 2, left, [change("a", 1, "/l/0", "a")]) == (state, 2, left)
    with pytest.raises(client.MissingChanges):
        client.receive(state, 2, [], [change("z", 5, "/x", 1)])
    assert client.receive(state, 2, [], [change("z", 5, "", {"n": 1}, op="replace")])[:2] == ({"n": 1}, 5)


def test_view_without_stale_changes():
    stale, fresh = change("s", 4, "/l/9", 1, base=1), change("f", 5, "/l/0", 2, base=3)
    assert client.view({"l": []}, 3, [stale, fresh]) == {"l": [2]}
