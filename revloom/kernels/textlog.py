"""Logs of text deltas: commits behind what others wrote, compaction, and the guard against texts merged twice."""

from __future__ import annotations

from revloom.kernels import delta


def commit(log: list[tuple[int, list[dict]]], rev: int, change: list[dict]) -> list[dict]:
    """A change made at rev as it reads behind the log's later entries (rev, delta)."""
    for r, earlier in log:
        if r > rev:
            change = delta.transform(earlier, change, True)
    return change


def compact(log: list[tuple[int, list[dict]]], rev: int) -> list[tuple[int, list[dict]]]:
    """The log with its entries up to rev composed into one."""
    old, out = [d for r, d in log if r <= rev], [x for x in log if x[0] > rev]
    if not old:
        return out
    whole = old[0]
    for d in old[1:]:
        whole = delta.compose(whole, d)
    return [(max(r for r, _ in log if r <= rev), whole), *out]


def _spans(prior: str, changes: list[list[dict]]) -> list[tuple[str, bool]]:
    """(text, whether it is of the prior one) in order, after the changes."""
    marked = [{"insert": prior, "attributes": {"old": True}}]
    for c in changes:
        marked = delta.compose(marked, [{k: v for k, v in op.items() if k != "attributes"} for op in c])
    return [(op["insert"], "attributes" in op) for op in marked if isinstance(op.get("insert"), str)]


def duplicated(prior: str, changes: list[list[dict]], least: int = 64) -> bool:
    """Whether the changes seem to write a text once more that is already there."""
    if len(prior) < least:
        return False
    spans = _spans(prior, changes)
    if "".join(t for t, _ in spans).count(prior) >= 2:
        return True
    kept = "".join(t for t, old in spans if old)
    behind, before = kept, True
    for text, old in spans:
        if old:
            behind, before = behind[len(text) :], False
        elif len(text) >= least and (before and text in kept or behind.startswith(text)):
            return True
    return False


class Compacted(Exception):
    """A change was made at a revision inside a range that has been composed into one entry."""


def guarded(log: list[tuple[int, list[dict]]], ranges: list[tuple[int, int]], rev: int, change: list[dict]) -> list[dict]:
    """commit(), but for a base strictly inside a compacted range (first, last)."""
    if any(first <= rev < last for first, last in ranges):
        raise Compacted(f"revision {rev}")
    return commit(log, rev, change)


def rebase_pending(pending: list[dict], log: list[tuple[int, list[dict]]], own: int | None = None) -> list[dict]:
    """A text that waits, behind a log's entries (rev, delta), which come first; the entry of the own last commit is in it already."""
    for r, earlier in log:
        if r != own:
            pending = delta.transform(earlier, pending, True)
    return pending


class Held:
    """A text field at a client: revision, the delta on its way, and the one behind it. None stands for no delta."""

    def __init__(self, rev: int = 0, sending: list[dict] | None = None, pending: list[dict] | None = None):
        self.rev, self.sending, self.pending, self.lost = rev, sending, pending, False

    def receive(self, rev: int, change: list[dict]) -> list[dict] | None:
        """Another client's delta: what it does to the shown text, or None where it is old or a revision before it is missing."""
        if rev <= self.rev:
            return None
        if rev > self.rev + 1:
            self.lost = True
            return None
        self.rev, through = rev, change
        for name in ("sending", "pending"):
            mine = getattr(self, name)
            if mine is not None:
                setattr(self, name, delta.transform(through, mine, True))
                through = delta.transform(mine, through, False)
        return through

    def resync(self, rev: int, log: list[tuple[int, list[dict]]], own: int | None = None) -> None:
        """A server's log since the revision that is held, entry `own` being the own last commit."""
        for name in ("sending", "pending"):
            mine = getattr(self, name)
            if mine is not None:
                setattr(self, name, rebase_pending(mine, log, own))
        self.rev, self.lost = max(self.rev, rev), False
