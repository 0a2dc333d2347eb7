"""Keys between keys: base-62 strings with an integer part of variable length and a fraction."""

from __future__ import annotations

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"  # fixed value: the alphabet, in order
ZERO, SMALLEST = "a0", "A" + "0" * 26


def _whole(key: str) -> str:
    head = key[0]
    n = ord(head) - ord("a") + 2 if "a" <= head <= "z" else ord("Z") - ord(head) + 2 if "A" <= head <= "Z" else 0
    if not n or n > len(key):
        raise ValueError(f"not an order key: {key}")
    return key[:n]


LARGEST = "z" + DIGITS[-1] * 26


def _check(key: str, bound: str) -> None:
    """Nothing comes after the largest whole key or before the smallest, and no fraction ends in zero."""
    if key == bound or key[len(_whole(key)) :].endswith("0"):
        raise ValueError(f"not an order key: {key}")


def _next(whole: str) -> str | None:
    head, n = whole[0], int_of(whole[1:]) + 1
    if n < 62 ** (len(whole) - 1):
        return head + of_int(n, len(whole) - 1)
    if head == "z":
        return None
    if head == "Z":
        return ZERO
    longer = len(whole) - 1 + (1 if head > "Z" else -1)
    return chr(ord(head) + 1) + DIGITS[0] * longer


def _previous(whole: str) -> str | None:
    head, n = whole[0], int_of(whole[1:]) - 1
    if n >= 0:
        return head + of_int(n, len(whole) - 1)
    if head == "A":
        return None
    if head == "a":
        return "Z" + DIGITS[-1]
    longer = len(whole) - 1 + (1 if head < "a" else -1)
    return chr(ord(head) - 1) + DIGITS[-1] * longer


def int_of(digits: str) -> int:
    n = 0
    for d in digits:
        n = n * 62 + DIGITS.index(d)
    return n


def of_int(n: int, width: int) -> str:
    out = ""
    for _ in range(width):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def _middle(a: str, b: str | None) -> str:
    """A fraction strictly between two, the second one open if None."""
    out = ""
    while b and len(out) < len(b) and (a[len(out) : len(out) + 1] or "0") == b[len(out)]:
        out += b[len(out)]
    a, b = a[len(out) :], b[len(out) :] if b else b
    low, high = DIGITS.index(a[0]) if a else 0, DIGITS.index(b[0]) if b else 62
    if high - low > 1:
        return out + DIGITS[(low + high + 1) // 2]
    if b and len(b) > 1:
        return out + b[0]
    return out + DIGITS[low] + _middle(a[1:], None)


def between(a: str | None, b: str | None) -> str:
    """A key strictly between a and b, either of them open if empty."""
    if a and b and a >= b:
        a, b = b, a
    if not a and not b:
        return ZERO
    if a:
        _check(a, LARGEST)
    if b:
        _check(b, SMALLEST)
    if not a:
        whole = _whole(b)
        if whole == SMALLEST:
            return whole + _middle("", b[len(whole) :])
        return whole if whole < b else _previous(whole)
    low = _whole(a)
    rest = a[len(low) :]
    if not b:
        up = _next(low)
        return low + _middle(rest, None) if up is None else up
    high = _whole(b)
    if low == high:
        return low + _middle(rest, b[len(high) :])
    up = _next(low)
    return up if up is not None and up < b else low + _middle(rest, None)


def spread(a: str | None, b: str | None, n: int) -> list[str]:
    """n keys in order between a and b: halved between two bounds, one after another at an open end."""
    if n <= 0:
        return []
    if not b or not a:
        out = [between(a, b)]
        for _ in range(n - 1):
            out.append(between(out[-1], b) if not b else between(a, out[-1]))
        return out if not b else out[::-1]
    c, half = between(a, b), n // 2
    if n == 1:
        return [c]
    return [*spread(a, c, half), c, *spread(c, b, n - half - 1)]


def heal(items: list[tuple[str, str]]) -> dict[str, str]:
    """New order keys for those of the (key, order) items, sorted by both, that don't come after the one before."""
    items = sorted(items, key=lambda x: (x[1], x[0]))
    out: dict[str, str] = {}
    last: str | None = None
    for i, (key, order) in enumerate(items):
        if last is not None and order <= last:
            after = next((o for _, o in items[i + 1 :] if o > last), None)
            order = out[key] = between(last, after)
        last = order
    return out
