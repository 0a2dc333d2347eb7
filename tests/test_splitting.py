import random

from hypothesis import given, settings
from hypothesis import strategies as st

from revloom.kernels import delta, lz, patch, splitting, textlog


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("abé😀", max_size=300))
def test_lz_round_trips(text):
    for there, back in ((lz.to_base64, lz.from_base64), (lz.to_uri, lz.from_uri), (lz.to_utf16, lz.from_utf16), (lz.to_bytes, lz.from_bytes)):
        assert back(there(text)) == text


def test_lz_shrinks():
    assert len(lz.to_base64("some words again and again. " * 200)) < 1500


def test_split_is_the_same_change():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("ab é😀\n") for _ in range(rng.randint(1, 900)))
        ops = [{"op": "@txt", "path": "/t", "value": [{"retain": 2}, {"insert": text}, {"delete": 1}, {"insert": "z" * 90, "attributes": {"b": True}}]}, {"op": "add", "path": "/d", "value": {"k": 1, "body": [{"insert": text + "\n"}]}}]
        base = {"t": [{"insert": "hello\n"}]}
        parts, report = splitting.split([{"id": "a", "rev": 1, "ops": ops}, {"id": "b", "rev": 2, "ops": []}], 300)
        assert not report and all(patch.size(p) <= 300 for p in parts)
        assert [p["rev"] for p in parts] == list(range(1, len(parts) + 1)) and parts[0]["id"] == "a" and parts[-1]["id"] == "b"
        state = base
        for p in parts:
            state = patch.apply(state, p["ops"], strict=True)
        assert state == patch.apply(base, ops, strict=True)
    assert splitting.split([{"id": "a", "rev": 1, "ops": [{"op": "add", "path": "/x", "value": "y" * 500}]}], 300)[1] == [(1, "value-not-object")]


def test_text_log():
    log = [(1, [{"insert": "abc"}]), (2, [{"retain": 3}, {"insert": "d"}])]
    assert textlog.commit(log, 1, [{"retain": 3}, {"insert": "X"}]) == [{"retain": 4}, {"insert": "X"}]
    assert textlog.compact(log, 2) == [(2, [{"insert": "abcd"}])]


def test_duplication_guard():
    prior = "".join(f"word {i} " for i in range(30))
    assert textlog.duplicated(prior, [[{"insert": prior}]]) and textlog.duplicated(prior, [[{"insert": prior[40:140]}]])
    assert textlog.duplicated(prior, [[{"retain": 100}, {"insert": prior[100:170]}]])
    assert not textlog.duplicated(prior, [[{"insert": "quite another text " * 9}]]) and not textlog.duplicated("short", [[{"insert": "short"}]])
    assert delta.plain([{"insert": prior}]) == prior
