"""Changes cut to a size: by op, then within texts and within values that hold texts."""

from __future__ import annotations

from revloom.kernels import delta, patch


def _halves(text: str) -> tuple[str, str] | None:
    """A text in two at its middle in UTF-16 units, never within a surrogate pair; None if it has one character."""
    units = delta._units(text)
    at = len(units) // 2
    if at and units[at - 1][1] & 0xFC == 0xD8:
        at -= 1
    if not at:
        at = 2 if len(units) > 2 else 0
    return (delta._text(units[:at]), delta._text(units[at:])) if at else None


def text_pieces(ops: list[dict], most: int) -> list[list[dict]]:
    """Deltas to apply one after the other instead of ops, each of at most `most` bytes where a character allows it."""
    todo, out, now, at = list(reversed(ops)), [], [], 0  # at: length of what is behind, in the text as it will be
    while todo:
        op = todo.pop()
        trial = [*now, op] if now else ([{"retain": at}] if at else []) + [op]
        if patch.size(trial) <= most:
            now = trial
        elif now and any("retain" not in x or "attributes" in x for x in now):
            out.append(now)
            now = []
            todo.append(op)
            continue
        elif isinstance(op.get("insert"), str) and (two := _halves(op["insert"])):
            todo += [op | {"insert": two[1]}, op | {"insert": two[0]}]
            continue
        else:
            out.append(trial)  # no smaller piece
            now = []
        at += 0 if "delete" in op else delta.length(op)
    return out + ([now] if now and any("retain" not in x or "attributes" in x for x in now) else [])


def _is_text(value) -> bool:
    ops = delta.ops_of(value)
    return bool(ops) and all(isinstance(o, dict) and "insert" in o for o in ops) and isinstance(ops[-1]["insert"], str) and ops[-1]["insert"].endswith("\n")


def _stubs(value, path: str, taken: list[tuple[str, list[dict]]]):
    """A value with its texts emptied; what they were goes to taken."""
    if _is_text(value):
        ops = delta.ops_of(value)
        taken.append((path, ops))
        return [{"insert": "\n"}] if isinstance(value, list) else value | {"ops": [{"insert": "\n"}]}
    if isinstance(value, dict):
        return {k: _stubs(v, f"{path}/{patch.escape(k)}", taken) for k, v in value.items()}
    if isinstance(value, list):
        return [_stubs(v, f"{path}/{i}", taken) for i, v in enumerate(value)]
    return value


def _fill(ops: list[dict]) -> list[dict]:
    """The delta that makes a text of ops from an empty one, whose newline stays."""
    last = ops[-1]["insert"][:-1]
    marks = {k: v for k, v in ops[-1].items() if k == "attributes"}
    return [*ops[:-1], *([{"insert": last} | marks] if last else []), *([{"retain": 1} | marks] if marks else [])]


def op_pieces(op: dict, most: int) -> tuple[list[dict], str | None]:
    """(ops to apply instead of op, why one of them is still larger than `most` bytes)."""
    room, why = max(1, most - patch.size(op | {"value": []})), None
    if patch.size(op) <= most:
        return [op], None
    if op["op"] == "@txt":
        out = [op | {"value": v} for v in text_pieces(delta.ops_of(op["value"]), room)]
        why = "insert-chunk"
    elif op["op"] in ("add", "replace"):
        taken: list[tuple[str, list[dict]]] = []
        value = _stubs(op["value"], op["path"], taken)
        if not taken:
            return [op], "value-no-text" if isinstance(op["value"], dict) else "value-not-object"
        out = [op | {"value": value}]
        for path, ops in taken:
            out += [{"op": "@txt", "path": path, "value": v} for v in text_pieces(_fill(ops), max(1, most - patch.size({"op": "@txt", "path": path, "value": []})))]
        why = "value-no-text"
    else:
        return [op], "delta-op" if op["op"].startswith("@") else "op-type"
    return out, why if any(patch.size(o) > most for o in out) else None


def split(changes: list[dict], most: int) -> tuple[list[dict], list[tuple[int, str]]]:
    """Changes of at most `most` bytes of JSON and (rev, reason) of what stays larger; later revs move up.

    The first piece of a change keeps its id, the others get a numbered one.
    """
    out, report, shift = [], [], 0
    for c in changes:
        base = c | {"rev": c["rev"] + shift}
        if patch.size(base) <= most:
            out.append(base)
            continue
        room = max(1, most - patch.size(base | {"ops": [], "id": f"{c['id']}-000000"}))
        groups: list[list[dict]] = []
        for op in c["ops"]:
            ops, why = op_pieces(op, room)
            if why:
                report.append((base["rev"], why))
            for o in ops:
                if groups and patch.size([*groups[-1], o]) - 2 <= room:
                    groups[-1].append(o)
                else:
                    groups.append([o])
        for i, ops in enumerate(groups):
            out.append(base | {"id": c["id"] if not i else f"{c['id']}-{i}", "rev": base["rev"] + i, "ops": ops})
        shift += max(0, len(groups) - 1)
    return out, report
