"""What a client holds: a committed state, and pending changes shown on top of it."""

from __future__ import annotations

from revloom.kernels import patch, transform


class MissingChanges(Exception):
    """Committed changes don't follow on the revision that is held."""


def receive(state, rev: int, pending: list[dict], committed: list[dict]) -> tuple[object, int, list[dict]]:
    """(state, rev, pending) after committed changes (id, rev, ops): known ones are skipped, pending ones rebased.

    A gap is an error, but before a single op that replaces the whole document.
    """
    new = [c for c in committed if c["rev"] > rev]
    if not new:
        return state, rev, pending
    whole = len(new[0]["ops"]) == 1 and new[0]["ops"][0]["op"] == "replace" and not new[0]["ops"][0]["path"]
    if new[0]["rev"] != rev + 1 and not whole or any(b["rev"] != a["rev"] + 1 for a, b in zip(new, new[1:])):
        raise MissingChanges(f"{new[0]['rev']} after {rev}")
    for c in new:
        state = patch.apply(state, c["ops"], strict=True)
    return state, new[-1]["rev"], transform.rebase(new, pending)


def view(state, rev: int, pending: list[dict]):
    """The state with pending changes on it; if they don't apply, with those made on this revision or later."""

    def on(changes: list[dict]):
        out = state
        for c in changes:
            out = patch.apply(out, c["ops"], strict=True)
        return out

    try:
        return on(pending)
    except patch.PatchError:
        return on([c for c in pending if c["base_rev"] >= rev])
