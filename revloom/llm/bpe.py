"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens, whose paths are the correct
tokenizations and no others. It starts with one state and a loop for each base symbol. The gadget of a merge
u + v -> w redirects every arc u to a copy of its target without the arc v, and gives each state that
has the arc u an arc w to where v leads. All arcs of one label share a target, so a gadget is one new state: its
parent in a tree and the arc that it lost. An arc exists unless the state's branch lost it, or
lost a left part of its token before the merge that made the next larger part. States visited are tabled.

A pre-split word is encoded by walking its positions: each has one correct tokenization of what stands before it,
so one state; the token that ends there is the one which an earlier position's state has an arc for. Which tokens end
at a position comes from a trie with failure links, a step a byte. Decoding emits the labels of the arcs.

Defined cases: a null text is empty: no tokens, decoded to the empty text. The strings of special tokens
in a text are those tokens, as in the library. Rows that repeat get equal ids.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from revloom.llm.common import map_rows

END = "</w>"


class Automaton:
    """States are numbers, 0 the start; to(state, token) is the next state, or -1 without such an arc."""

    def __init__(self, size: int, merges: list[tuple[int, int, int]]):
        self.left, self.made = [-1] * size, [-1] * size
        self.target = [0] * size
        parent, lost, when = [-1], [-1], [-1]
        for k, (u, v, w) in enumerate(merges):
            self.left[w], self.made[w] = u, k
            self.target[w] = self.target[v]
            parent.append(self.target[u])
            lost.append(v)
            when.append(k)
            self.target[u] = len(parent) - 1
        self.when = when
        # a state's branch is found by the intervals of a walk over the tree of states
        below: list[list[int]] = [[] for _ in parent]
        for s in range(1, len(parent)):
            below[parent[s]].append(s)
        self.enter, leave, clock, stack = [0] * len(parent), [0] * len(parent), 0, [(0, False)]
        while stack:
            s, over = stack.pop()
            if over:
                leave[s] = clock
                continue
            self.enter[s] = clock
            clock += 1
            stack.append((s, True))
            stack.extend((x, False) for x in below[s])
        losing: dict[int, list[tuple[int, int, int]]] = {}
        for s in range(1, len(parent)):
            losing.setdefault(lost[s], []).append((self.enter[s], leave[s], when[s]))
        self.losing = {t: sorted(x) for t, x in losing.items()}
        self.table: dict[int, int] = {}

    def _lost(self, state: int, token: int) -> int:
        """The merge at which the state's branch lost its arc for the token, or a number beyond all."""
        found = self.losing.get(token)
        if found:
            at = self.enter[state]
            i = bisect.bisect_right(found, (at, 1 << 60, 0)) - 1
            if i >= 0 and found[i][1] > at:
                return found[i][2]
        return 1 << 61

    def to(self, state: int, token: int) -> int:
        key = state << 20 | token
        out = self.table.get(key)
        if out is None:
            part, before, out = token, 1 << 60, self.target[token]
            while part >= 0:
                if self._lost(state, part) <= before:
                    out = -1
                    break
                part, before = self.left[part], self.made[part]
            if len(self.table) < 2_000_000:
                self.table[key] = out
        return out


class Suffixes:
    """All tokens that end at a position, the longest first: a trie of the tokens' bytes with failure links (Aho and Corasick, 1975).

    step(node, byte) is the next node, 0 the start; inner and final hold a node's (length, token) pairs, final those of
    tokens that end a word. Steps over failure links are tabled as they come up.
    """

    def __init__(self, inner: dict[bytes, int], final: dict[bytes, int]):
        self.table: dict[int, int] = {}
        ends: list[list[int | None]] = [[None, None]]
        order: list[tuple[int, int, int, int]] = []  # parent, byte, node, depth
        for kind, tokens in enumerate((inner, final)):
            for name, t in tokens.items():
                node = 0
                for depth, b in enumerate(name, 1):
                    below = self.table.get(node << 8 | b)
                    if below is None:
                        below = self.table[node << 8 | b] = len(ends)
                        ends.append([None, None])
                        order.append((node, b, below, depth))
                    node = below
                ends[node][kind] = t
        self.fail = [0] * len(ends)
        self.inner: list[tuple] = [()] * len(ends)
        self.final: list[tuple] = [()] * len(ends)
        own = dict(self.table)
        for parent, b, node, depth in sorted(order, key=lambda x: x[3]):
            up = self.fail[parent]
            while parent and up and own.get(up << 8 | b) is None:
                up = self.fail[up]
            self.fail[node] = up = own.get(up << 8 | b, 0) if parent else 0
            for found, t in ((self.inner, ends[node][0]), (self.final, ends[node][1])):
                found[node] = found[up] if t is None else ((depth, t), *found[up])
        self.room = len(self.table) + 1_000_000

    def step(self, node: int, b: int) -> int:
        up, out = node, self.table.get(node << 8 | b)
        while out is None and up:
            up = self.fail[up]
            out = self.table.get(up << 8 | b)
        if len(self.table) < self.room:
            self.table[node << 8 | b] = out or 0
        return out or 0


def _byte_names() -> list[str]:
    """The printable character that stands for each byte, as byte-level vocabularies name them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Tokenizer:
    """Word-level BPE with word ends, read from a tokenizers file: encode() and decode()."""

    def __init__(self, path: str, cache: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # what word() and chunk() are written for; any other file would give wrong ids without a word
        steps = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = [{k: v for k, v in p.items() if k != "pattern"} for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        wanted = [{"type": "Split", "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        if steps != ["NFC", "Replace", "Lowercase"] or parts != wanted or spec["model"]["type"] != "BPE" or spec["model"].get("end_of_word_suffix") != END or spec["model"].get("byte_fallback"):
            raise ValueError(f"{path}: a vocabulary with another normaliser, splitter or model than word-level BPE with word ends")
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = self.vocab | self.special
        self.labels = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.labels[i] = name
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = Automaton(len(self.labels), [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs])
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.gap = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        byte = {c: b for b, c in enumerate(_byte_names())}
        inner, final = ({bytes(byte[c] for c in t.removesuffix(END)): i for t, i in self.vocab.items() if t not in self.special and t.endswith(END) == ends} for ends in (False, True))
        if any(bytes([b]) not in tokens for b in range(256) for tokens in (inner, final)):
            raise ValueError(f"{path}: a vocabulary without a token for each byte")
        self.suffixes = Suffixes(inner, final)
        self.cache, self.old, self.room = {}, {}, cache

    def word(self, word: str) -> list[int]:
        """The ids of a pre-split word, already normalised."""
        to, table, step, steps, inner = self.automaton.to, self.automaton.table, self.suffixes.step, self.suffixes.table, self.suffixes.inner
        data = word.encode("utf-8", "surrogatepass")
        last = len(data) - 1
        node, states, back = 0, [0], [(0, 0)]
        for i, b in enumerate(data):
            below = steps.get(node << 8 | b)
            node = step(node, b) if below is None else below
            for found in inner[node] if i < last else self.suffixes.final[node]:
                size, t = found
                x = table.get(states[-size] << 20 | t)
                if x is None:
                    x = to(states[-size], t)
                if x >= 0:
                    states.append(x)
                    back.append(found)
                    break
        out, i = [], len(data)
        while i:
            size, t = back[i]
            out.append(t)
            i -= size
        return out[::-1]

    def chunk(self, chunk: str) -> list[int]:
        """The ids of a run of characters that aren't white space."""
        s = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        out = []
        for w in self.split(s.lower()):
            ids = self.cache.get(w) or self.old.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 48:
                    self._keep(w, ids)
            out += ids
        return out

    def _keep(self, key: str, ids: list[int]) -> None:
        """A cache of two generations: at most 2 * room entries, and what is used again stays."""
        if len(self.cache) >= self.room:
            self.cache, self.old = {}, self.cache
        self.cache[key] = ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self.specials.split(text or ""):
            if part in self.special:
                out.append(self.special[part])
                continue
            plain = part.isascii() and part.isprintable() or not any(c in part for c in "\x1c\x1d\x1e\x1f")
            known = self.cache.get
            for c in part.split() if plain else self.gap.split(part):
                ids = known(c)
                if ids is None:
                    if not c:
                        continue
                    ids = self.old.get(c)
                    if ids is None:
                        ids = self.chunk(c)
                    if len(c) <= 48:
                        self._keep(c, ids)
                    known = self.cache.get  # both may have begun another generation
                out += ids
        return out

    def decode(self, ids) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in ids])


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, compiled once in a process."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs (doc_id, text)."""

    def make(batches):
        t = load(path)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": [np.array(t.encode(x), np.int32) for x in b["text"]]}

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text)."""

    def make(batches):
        t = load(path)
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for x in b["text"]:
                ids = t.encode(x)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(t.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield out

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
