"""Op lists made call by call, pointers made key by key, changes as rows, and sizes of what is stored."""

from __future__ import annotations

import json
import secrets

from revloom.kernels import lz, patch, transform


class Pointer:
    """A path made by attributes and items: str(Pointer().items[3].title) is /items/3/title. Nothing can be set on it."""

    __slots__ = ("_path",)

    def __init__(self, path: str = ""):
        object.__setattr__(self, "_path", path)

    def __getattr__(self, key: str) -> Pointer:
        if key.startswith("__"):
            raise AttributeError(key)
        return self[key]

    def __getitem__(self, key) -> Pointer:
        return Pointer(f"{self._path}/{patch.escape(str(key))}")

    def __setattr__(self, key: str, value) -> None:
        raise AttributeError("a pointer is only read")

    def __str__(self) -> str:
        return self._path


class Ops:
    """A list of ops that grows by its methods, each of which returns it. Paths are strings or Pointers."""

    def __init__(self, ops: list[dict] = ()):
        self.ops = list(ops)

    def _put(self, op: str, path, **rest) -> Ops:
        path = str(path)
        if path and not path.startswith("/"):
            path = "/" + path
        self.ops.append({"op": op, "path": path, **rest})
        return self

    def test(self, path, value) -> Ops:
        return self._put("test", path, value=value)

    def add(self, path, value, soft: bool = False) -> Ops:
        return self._put("add", path, value=value, **({"soft": True} if soft else {}))

    def replace(self, path, value=patch.MISSING, soft: bool = False) -> Ops:
        """A replace without a value removes."""
        return self.remove(path) if value is patch.MISSING else self._put("replace", path, value=value, **({"soft": True} if soft else {}))

    def remove(self, path) -> Ops:
        return self._put("remove", path)

    def copy(self, origin, path) -> Ops:
        return self._put("copy", path, **{"from": str(origin)})

    def move(self, origin, path) -> Ops:
        """To where it is, nothing."""
        return self if str(origin) == str(path) else self._put("move", path, **{"from": str(origin)})

    def increment(self, path, by=1) -> Ops:
        return self._put("@inc", path, value=by)

    def decrement(self, path, by=1) -> Ops:
        return self.increment(path, -by)

    def most(self, path, value) -> Ops:
        return self._put("@max", path, value=value)

    def least(self, path, value) -> Ops:
        return self._put("@min", path, value=value)

    def bit(self, path, index: int, on: bool) -> Ops:
        return self._put("@bit", path, value=patch.bitmask(index, on))

    def text(self, path, delta: list[dict]) -> Ops:
        return self._put("@txt", path, value=delta)

    def updates(self, values: dict, path="") -> Ops:
        """A replace for each key, a remove where its value is None."""
        for k, v in values.items():
            at = f"{path}/{patch.escape(k)}"
            self.remove(at) if v is None else self.replace(at, v)
        return self

    def apply(self, state, **how):
        return patch.apply(state, self.ops, **how)

    def transform(self, others: Ops | list[dict], state=None) -> Ops:
        """The others as they read behind these."""
        return Ops(transform.transform(self.ops, others.ops if isinstance(others, Ops) else others, state=state))

    def invert(self, state) -> Ops:
        return Ops(patch.invert(state, self.ops))

    def compose(self, others: Ops | None = None) -> Ops:
        return Ops(patch.compose(self.ops + (others.ops if others else [])))

    def concat(self, others: Ops) -> Ops:
        return Ops(self.ops + others.ops)

    def to_json(self) -> str:
        return json.dumps(self.ops, separators=(",", ":"), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Ops:
        return cls(json.loads(text))


def build(fill) -> list[dict]:
    """The ops that fill(ops, root pointer) makes."""
    ops = Ops()
    fill(ops, Pointer())
    return ops.ops


def change_input(ops: list[dict], created_at: int, id: str | None = None, **more) -> dict:
    """A change for a server to number: without rev and base."""
    return {"id": id or secrets.token_urlsafe(6), "ops": ops, "created_at": created_at, **more}


def change(base_rev: int, rev: int, ops: list[dict], created_at: int, id: str | None = None, **more) -> dict:
    """A change with its place; committed_at is 0, which marks it as pending, until a server sets it."""
    return {"id": id or f"{rev}-{secrets.token_urlsafe(6)}", "base_rev": base_rev, "rev": rev, "ops": ops, "created_at": created_at, "committed_at": 0, **more}


def is_pending(row: dict) -> bool:
    return row["committed_at"] == 0


def _json(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def stored_size(data, form: str = "base64") -> int:
    """Bytes of a value as a compressing store keeps it, form 'base64' or 'bytes'. Of a change, its ops alone are compressed."""
    if data is None:
        return 0
    pack = lz.to_base64 if form == "base64" else lz.to_bytes
    if isinstance(data, dict) and isinstance(data.get("ops"), list):
        rest, ops = {k: v for k, v in data.items() if k != "ops"}, pack(_json(data["ops"]))
        return len(_json(rest | {"ops": ops}).encode()) if form == "base64" else len(_json(rest).encode()) + len(ops)
    return len(pack(_json(data)))
