"""A growing dictionary coder over UTF-16 units, stored as base64, URI text, UTF-16 text or bytes.

Codes 0 and 1 bring in a new unit of 8 or 16 bits, 2 ends the stream; codes widen as the dictionary grows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

_LETTERS = string.ascii_uppercase + string.ascii_lowercase + string.digits
BASE64, URI = _LETTERS + "+/", _LETTERS + "+-$"


class _Width:
    """The width of codes, which grows by one when as many codes were used as the last width had."""

    def __init__(self, bits: int = 2, left: int = 2):
        self.bits, self.left = bits, left

    def used(self) -> None:
        self.left -= 1
        if not self.left:
            self.left = 1 << self.bits
            self.bits += 1


def _codes(units: list[int]) -> Iterator[tuple[int, int]]:
    """(value, bits) of each code."""
    known: dict[tuple, int] = {}
    fresh, width = set(), _Width()

    def emit(phrase: tuple) -> Iterator[tuple[int, int]]:
        if phrase in fresh:
            wide = phrase[0] > 255
            yield int(wide), width.bits
            yield phrase[0], 16 if wide else 8
            width.used()
            fresh.discard(phrase)
        else:
            yield known[phrase], width.bits
        width.used()

    phrase: tuple = ()
    for u in units:
        if (u,) not in known:
            known[(u,)] = len(known) + 3
            fresh.add((u,))
        if (longer := (*phrase, u)) in known:
            phrase = longer
            continue
        yield from emit(phrase)
        known[longer] = len(known) + 3
        phrase = (u,)
    if phrase:
        yield from emit(phrase)
    yield 2, width.bits


def _pack(text: str, size: int) -> list[int]:
    """The stream in words of `size` bits; at least one bit of padding follows it."""
    raw = text.encode("utf-16-le", "surrogatepass")
    bits = "".join(format(v, f"0{n}b")[::-1] for v, n in _codes([raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]))
    bits += "0" * (size - len(bits) % size)
    return [int(bits[i : i + size], 2) for i in range(0, len(bits), size)]


def _unpack(words: list[int], size: int) -> str | None:
    """The text of a stream, None if it is broken."""
    bits, at = "".join(format(w, f"0{size}b") for w in words), 0

    def read(n: int) -> int:
        nonlocal at
        at += n
        return int(bits[at - n : at][::-1] or "0", 2)

    entries: list[tuple] = [(), (), ()]
    width, last, out = _Width(), (), []
    while at < len(bits):
        code = read(width.bits)
        if code == 2:
            return b"".join(u.to_bytes(2, "little") for u in out).decode("utf-16-le", "surrogatepass")
        if code < 2:
            entries.append((read(8 << code),))
            code = len(entries) - 1
            width.used()
        if code > len(entries) or code == len(entries) and not last:
            return None
        now = entries[code] if code < len(entries) else (*last, last[0])
        out += now
        if last:
            entries.append((*last, now[0]))
        width.used() if last else None
        if not last:
            width = _Width(3, 4)
        last = now
    return None


def to_base64(text: str) -> str:
    out = "".join(BASE64[w] for w in _pack(text, 6))
    return out + "=" * (-len(out) % 4)


def from_base64(data: str) -> str | None:
    return _unpack([BASE64.index(c) for c in data.rstrip("=")], 6)


def to_uri(text: str) -> str:
    return "".join(URI[w] for w in _pack(text, 6))


def from_uri(data: str) -> str | None:
    return _unpack([URI.index(c) for c in data.replace(" ", "+")], 6)


def to_utf16(text: str) -> str:
    return "".join(chr(w + 32) for w in _pack(text, 15)) + " "


def from_utf16(data: str) -> str | None:
    return _unpack([ord(c) - 32 for c in data[:-1]], 15)


def to_bytes(text: str) -> bytes:
    return b"".join(w.to_bytes(2, "big") for w in _pack(text, 16))


def from_bytes(data: bytes) -> str | None:
    return _unpack([int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)], 16)
