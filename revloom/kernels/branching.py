"""Branches of a document under operational transform, and queues that wait for a server.

A branch's changes are a queue on the revision where it began; the source's later changes are committed ones. Merging is the
walk of the ones through the others, cut to windows that a commit may hold. Own changes that an earlier merge committed
come back among the source's as echoes and leave the queue.
"""

from __future__ import annotations

from collections.abc import Iterator

from revloom.kernels import patch, transform


class Gap(Exception):
    """The source's changes don't follow on the revision where the branch began."""


def merge(source: list[dict], began: int, branch: list[dict], most: int = 2000, most_bytes: int = 4 << 20) -> Iterator[list[dict]]:
    """Windows of the branch's changes (id, ops) behind the source's (id, rev, ops) since `began`, with the revs that they get.

    A window holds up to `most` changes and `most_bytes` bytes of ops, one change at least. What is left without ops is
    dropped. The source's changes must have each revision after `began`.
    """
    since = [c for c in source if c["rev"] > began]
    if [c["rev"] for c in since] != list(range(began + 1, began + 1 + len(since))):
        raise Gap(f"after {began}")
    rev, window, used = began + len(since), [], 0
    for q in transform.behind(since, branch)[0]:
        if not q["ops"]:
            continue
        rev += 1
        size = patch.size(q["ops"])
        if window and (len(window) == most or used + size > most_bytes):
            yield window
            window, used = [], 0
        window.append(q | {"base_rev": rev - 1, "rev": rev})
        used += size
    if window:
        yield window


def rebase_indebted(committed: list[dict], queue: list[dict], frame: int) -> list[dict]:
    """rebase() for a queue in which some changes were made before `frame`, the revision that the others stand on.

    Those keep their ops and base, as the server still has to walk them; nothing is walked through them, either. All are
    numbered anew in their order, and echoes go.
    """
    if not committed:
        return queue
    moved = {q["id"]: q for q in transform.rebase(committed, [q for q in queue if q["base_rev"] >= frame])}
    echoes = {c["id"] for c in committed}
    rows = [q if q["base_rev"] < frame else moved.get(q["id"]) for q in queue if q["id"] not in echoes]
    return [q | {"rev": committed[-1]["rev"] + i} for i, q in enumerate((q for q in rows if q), 1)]


def optimistic(committed: list[dict], queue: list[dict], shown: list[list[dict]]) -> list[list[dict]]:
    """Op lists that are shown but not queued yet, behind committed changes that went through the queue first; empty ones go."""
    marks = [{"id": ("shown", i), "ops": ops} for i, ops in enumerate(shown)]
    after = transform.behind(committed, [*queue, *marks])[0]
    return [q["ops"] for q in after if isinstance(q["id"], tuple) and q["ops"]]


def applies(state, queue: list[dict], asked) -> bool:
    """Whether a change of the queue applies strictly where it was made. Where that can't be told, it is taken to."""
    at = next((i for i, q in enumerate(queue) if q["id"] == asked), None)
    if at is None:
        return True
    for i, q in enumerate(queue[: at + 1]):
        try:
            state = patch.apply(state, q["ops"], strict=True)
        except patch.PatchError:
            return i < at
    return True


class Failures:
    """Strict failures of committed changes: one is passed over once it failed often enough, on a reloaded state as well."""

    FLOOR = 2

    def __init__(self):
        self.count: dict[object, int] = {}
        self.reloaded: set = set()
        self.open: set = set()  # failed and not passed over yet

    def floored(self, change) -> bool:
        return change in self.reloaded and self.count[change] >= self.FLOOR

    def failed(self, change) -> bool:
        """Counts a failure; whether the change is to be passed over from now on."""
        self.count[change] = self.count.get(change, 0) + 1
        (self.open.discard if self.floored(change) else self.open.add)(change)
        return self.floored(change)

    def reload(self) -> None:
        """A state from the server is in place: earlier failures count as one, but for changes already passed over."""
        for change in self.open:
            self.count[change] = min(self.count[change], self.FLOOR - 1)
        self.reloaded |= self.open


def pass_over(state, committed: list[dict], failures: Failures, at: int = 0) -> tuple[object, list[dict], object | None]:
    """(state, applied, stopped): changes in order from place `at` on; one that fails is applied without its ops once it is passed over, else it stops."""
    done = []
    for i in range(at, len(committed)):
        c = committed[i]
        ops = [] if failures.floored(c["id"]) else c["ops"]
        try:
            state = patch.apply(state, ops, strict=True)
        except patch.PatchError:
            if not failures.failed(c["id"]):
                return state, done, c["id"]
            ops = []
        done.append(c | {"ops": ops})
    return state, done, None


def swap(update: dict, row: dict, expected: dict) -> dict | None:
    """The row with an update, if it has what is expected, else None. What is expected as None must not be set; what isn't named isn't looked at."""
    return None if any(row.get(k) != v for k, v in expected.items()) else row | update
