"""Lists of path-addressed ops on JSON documents: apply, invert and compose.

A patch is a list of dicts with op, path and, by op, from and value. States are never changed in place.
"""

from __future__ import annotations

import copy
import json
import re

from revloom.kernels import delta

MISSING = object()
_INDEX = re.compile(r"^(0|[1-9][0-9]*)$")


class PatchError(Exception):
    pass


def keys(path: str) -> list[str]:
    return [k.replace("~1", "/").replace("~0", "~") for k in path.split("/")[1:]] if path else []


def escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _falsy(x) -> bool:
    return x is MISSING or x is None or x is False or x == "" or (x == 0 and not isinstance(x, bool) and isinstance(x, (int, float)))


def _child(node, key: str):
    if isinstance(node, dict):
        return node.get(key, MISSING)
    if isinstance(node, list):
        if key == "-":
            return node[-1] if node else MISSING
        if _INDEX.match(key) and int(key) < len(node):
            return node[int(key)]
    return MISSING


def get(state, path: str):
    """The value at a path or MISSING; a falsy value on the way counts as missing."""
    for i, k in enumerate(ks := keys(path)):
        state = _child(state, k)
        if i < len(ks) - 1 and _falsy(state):
            return MISSING
    return state


def same(a, b) -> bool:
    """Equal JSON values; booleans differ from numbers."""
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def is_soft(op: dict) -> bool:
    return bool(op.get("soft")) or op["op"] == "add" and op.get("value") in ({}, []) and isinstance(op.get("value"), (dict, list))


def apply_mask(value: int, mask: int) -> int:
    return (value & ~(mask >> 15 & 0x7FFF)) | mask & 0x7FFF


def combine_masks(a: int, b: int) -> int:
    a_off, a_on, b_off, b_on = a >> 15 & 0x7FFF, a & 0x7FFF, b >> 15 & 0x7FFF, b & 0x7FFF
    return ((a_off & ~b_on) | b_off) << 15 | (a_on & ~b_off) | b_on


def bitmask(index: int, on: bool) -> int:
    if not 0 <= index <= 14:
        raise ValueError("a bit is 0 to 14")
    return 1 << (index if on else index + 15)


def delta_value(op: str, current, value):
    """What an in-place op makes of the current value."""
    if op == "@inc":
        return (0 if _falsy(current) else current) + value
    if op == "@bit":
        return apply_mask(0 if _falsy(current) else current, value)
    unset = current is MISSING or current is None
    if op == "@max":
        return value if unset or value > current else current
    return value if unset or value < current else current


def _parent(root: list, path: str, make: str | None):
    """(container, last key) with the containers on the way copied; make: whether and how missing ones are made."""
    ks = keys(path)
    holder, at = root, 0
    node = root[0]
    for i, k in enumerate(ks):
        if _falsy(node) or not isinstance(node, (dict, list)):
            if make is None or not _falsy(node):
                return None, ks[-1]
            node = [] if make == "array" and k in ("0", "-") and i else {}
        else:
            node = list(node) if isinstance(node, list) else dict(node)
        holder[at] = node
        if i == len(ks) - 1:
            return node, k
        if isinstance(node, list):
            if k == "-":
                if not node:
                    if make is None:
                        return None, ks[-1]
                    node.append(None)
                at = len(node) - 1
            elif _INDEX.match(k) and int(k) < len(node):
                at = int(k)
            elif make == "array" and k == "0" and not node:
                node.append(None)
                at = 0
            else:
                return None, ks[-1]
            holder, node = node, node[at]
        else:
            holder, at = node, k
            node = node.get(k, MISSING)
            if node is MISSING and make is None:
                return None, ks[-1]
    return holder, at


def _index(node: list, key: str, most: int) -> int:
    at = len(node) if key == "-" else int(key or 0) if not key or key.isascii() and key.isdigit() else -1
    if not 0 <= at <= most:
        raise PatchError(f"no array index {key}")
    return at


def _set(root: list, path: str, value, insert: bool) -> None:
    if not path:
        root[0] = value
        return
    node, key = _parent(root, path, "array" if insert else "object")
    if node is None:
        raise PatchError(f"no parent of {path}")
    if isinstance(node, list):
        if insert:
            node.insert(_index(node, key, len(node)), value)
        else:
            node[_index(node, key, len(node) - 1)] = value
    else:
        node[key] = value


def _remove(root: list, path: str) -> None:
    if not path:
        root[0] = None
        return
    node, key = _parent(root, path, None)
    if node is None:
        return
    if isinstance(node, list):
        del node[_index(node, key, len(node) - 1)]
    else:
        node.pop(key, None)


def _step(root: list, op: dict, pad: bool) -> None:
    kind, path = op["op"], op["path"]
    if kind in ("add", "replace"):
        if "value" not in op:
            raise PatchError("no value")
        _set(root, path, copy.deepcopy(op["value"]), kind == "add")
    elif kind == "remove":
        _remove(root, path)
    elif kind in ("copy", "move"):
        if op["from"] == path:
            return
        value = get(root[0], op["from"])
        if value is MISSING:
            raise PatchError(f"nothing at {op['from']}")
        if kind == "move":
            _remove(root, op["from"])
        _set(root, path, copy.deepcopy(value), True)
    elif kind == "test":
        found = get(root[0], path)
        if found is MISSING or not same(found, op.get("value")):
            raise PatchError("test failed")
    elif kind in ("@inc", "@bit", "@max", "@min"):
        _set(root, path, delta_value(kind, get(root[0], path), op["value"]), False)
    elif kind == "@txt":
        now, change = get(root[0], path), delta.ops_of(op["value"])
        if change is None:
            raise PatchError("no text ops")
        _set(root, path, delta.apply_text(None if now is MISSING else now, change, pad), False)
    else:
        raise PatchError(f"unknown op {kind}")


def apply(state, ops: list[dict], strict: bool = False, rigid: bool = False, partial: bool = False, at_path: str = "", pad: bool = False):
    """The state after a patch. By default a failing op is skipped and a failing test gives the original state."""
    root = [state]
    for op in ops:
        if at_path:
            op = op | {"path": at_path + op["path"]} | ({"from": at_path + op["from"]} if "from" in op else {})
        if is_soft(op) and get(root[0], op["path"]) is not MISSING:
            continue
        before = root[0]
        try:
            _step(root, op, pad)
        except PatchError:
            root[0] = before
            if strict:
                raise
            if rigid or op["op"] == "test":
                return root[0] if partial else state
    return root[0]


def invert(state, ops: list[dict]) -> list[dict]:
    """A patch that undoes ops on state; tests are dropped."""
    out = []
    for op in ops:
        kind, path = op["op"], op["path"]
        old, parent = get(state, path), get(state, path.rpartition("/")[0])
        try:
            after = apply(state, [op], strict=True)
        except PatchError:  # it does nothing, so nothing is to undo
            continue
        if kind == "@txt" and old is not MISSING:
            base = delta.ops_of(old) or [{"insert": "\n"}]
            out.append([{"op": "@txt", "path": path, "value": delta.invert(delta.ops_of(op["value"]), base)}])
        elif kind == "remove":
            if old is not MISSING:
                out.append([{"op": "add", "path": path, "value": old}])
        elif kind == "move" and op["from"] != path:
            back = [{"op": "move", "from": path, "path": op["from"]}]
            if not isinstance(parent, list) and old is not MISSING:
                back.append({"op": "add", "path": path, "value": old})
            out.append(back)
        elif kind in ("add", "copy") and isinstance(parent, list):
            at = path if not path.endswith("/-") else f"{path[:-1]}{len(parent)}"
            out.append([{"op": "remove", "path": at}])
        elif kind not in ("test", "move") and after is not state:
            out.append([{"op": "remove", "path": path} if old is MISSING else {"op": "replace", "path": path, "value": old}])
        state = after
    return [op for group in reversed(out) for op in group]


_COMPOSE = {
    "@inc": lambda a, b: a + b,
    "@bit": combine_masks,
    "@max": max,
    "@min": min,
    "@txt": lambda a, b: delta.compose(delta.ops_of(a), delta.ops_of(b)),
    "replace": lambda a, b: b,
}


def compose(ops: list[dict]) -> list[dict]:
    """ops with runs of one composable op on one path merged; any other op, or a write above or below, ends the runs."""
    out: list[dict] = []
    last: dict[str, int] = {}
    for op in ops:
        path, merge = op["path"], _COMPOSE.get(op["op"])
        if merge is None:
            last.clear()
            out.append(op)
            continue
        for p in [p for p in last if p.startswith(path + "/") or path.startswith(p + "/")]:
            del last[p]
        at = last.get(path)
        if at is not None and out[at]["op"] == op["op"]:
            out[at] = out[at] | {"value": merge(out[at]["value"], op["value"])}
        else:
            last[path] = len(out)
            out.append(op)
    return out


def size(value) -> int:
    """Bytes of compact JSON in UTF-8."""
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))
