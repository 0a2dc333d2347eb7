"""Substring dedup by sliding sentence spans.

A text is cut into sentences, after a full stop, exclamation or question mark that white space follows and at line
ends; a sentence of over LONGEST words is cut further, after words whose hash says so, so that the
same words are cut alike wherever they stand. From every sentence on, and back from every sentence, the
shortest run of at least SPAN sentences and LEAST words is hashed over its lower-cased words: short
sentences make a run longer, none is left out. So whatever repeats with SPAN sentences and LEAST words
or more is covered by runs that lie within it, to its last sentence. The runs of all documents are joined globally:
the one in the smallest doc_id that is first there stays, and every sentence that any other one covers goes.

Defined cases: null text stays null and has no sentences; an empty text stays empty. Rows that share a
doc_id are one document: none of them is a repetition of the other; each loses what its own text repeats, as
positions are kept by doc_id and a hash of the text. A null doc_id never holds the first
one while a row with an id has it. Ties within a document go to the earlier run.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revloom.llm import shingles as S
from revloom.llm.common import map_rows, store

SPAN, LEAST, LONGEST = 3, 8, 24
_END = re.compile(r"(?<=[.!?])(?=[\x20\x09-\x0D])|(?<=\n)")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _cut(text: str | None) -> tuple[list[tuple[int, int]], list[int]]:
    """(start, end) of each sentence with a word in it, and how many words each has."""
    out, sizes, at = [], [], 0
    for m in [*_END.finditer(text or ""), None]:
        end = m.start() if m else len(text or "")
        n = len(_WORD.findall(text or "", at, end))
        if n > LONGEST:
            hashes, first = S.word_hashes(text[at:end]), 0
            ends = [w.end() for w in _WORD.finditer(text, at, end)]
            for j in (np.flatnonzero(hashes[:-1] % np.uint64(8) == 0)).tolist():
                if j + 1 - first >= 4:
                    out.append((at, ends[j]))
                    sizes.append(j + 1 - first)
                    at, first = ends[j], j + 1
            n -= first
        if n:
            out.append((at, end))
            sizes.append(n)
            at = end
    return out, sizes


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence with a word in it; together with the gaps before them they cover the text."""
    return _cut(text)[0]


def _runs(text: str | None, span: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of sentences: hash, first sentence, the one after its last, whether it's the text's first with this hash."""
    cut, sizes = _cut(text)
    k = len(cut)
    if k < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    words = S.word_hashes(text)
    # a cut never divides a word, so the words of the whole text are hashed once
    counts = np.cumsum([0, *sizes])
    each = np.arange(k + 1)
    end = np.maximum(each + span, np.searchsorted(counts, counts + least))  # of the run from a sentence on
    begin = np.minimum(each - span, np.searchsorted(counts, counts - least, "right") - 1)  # of the run before it
    on, back = end <= k, begin >= 0
    at, end = np.divmod(np.unique(np.concatenate([each[on] * (k + 1) + end[on], begin[back] * (k + 1) + each[back]])), k + 1)
    with np.errstate(over="ignore"):
        n = int(counts[-1])
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(words[:n] * S._power("up", n)[:n], dtype=np.uint64)])
        a, b = counts[at], counts[end]
        h = S.mix((prefix[b] - prefix[a]) * S._power("down", n + 1)[a] + (b - a).astype(np.uint64)).view(np.int64)
    first = np.zeros(len(h), bool)
    first[np.unique(h, return_index=True)[1]] = True
    return h, at, end, first


def runs(text: str | None, span: int = SPAN, least: int = LEAST) -> list[tuple[int, int, bool]]:
    """(hash, first sentence, whether it's the text's first run with this hash) of each run of sentences."""
    h, at, _, first = _runs(text, span, least)
    return list(zip(h.tolist(), at.tolist(), first.tolist()))


def _hashes(span: int, least: int):
    def make(batches):
        for b in batches:
            out = {c: [] for c in ("doc_id", "key", "h", "at", "end", "first")}
            for i, key, text in zip(b["doc_id"], b["key"], b["text"]):
                found = _runs(text, span, least)
                out["doc_id"] += [i] * len(found[0])
                out["key"] += [key] * len(found[0])
                for c, v in zip(("h", "at", "end", "first"), found):
                    out[c] += v.tolist()
            yield out

    return make


def _rebuild(columns: list[str]):
    def make(batches):
        for b in batches:
            b["n_sentences"], b["removed"], b["cleaned"] = [], [], []
            for text, at in zip(b["text"], b["at"]):
                cut = sentences(text)
                gone = sorted({j for x in at or () for j in range(x >> 32, x & 0xFFFFFFFF)})
                b["n_sentences"].append(len(cut))
                b["removed"].append(gone)
                if not gone:
                    b["cleaned"].append(text)
                    continue
                drop, end = set(gone), cut[-1][1]
                b["cleaned"].append("".join(text[x:y] for j, (x, y) in enumerate(cut) if j not in drop).lstrip("\x20\t\n\v\f\r") + text[end:])
            yield b

    return make


def drop_repeats(docs: DataFrame, span: int = SPAN, least: int = LEAST) -> DataFrame:
    """doc_id, text without repeated spans, n_sentences, n_removed, removed (their numbers)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))  # rows equal in both have equal runs
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = store(map_rows(docs, _hashes(span, least), f"doc_id {id_type}, key long, h long, at int, end int, first boolean"))  # read twice
    many = store(spans.groupBy("h").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("h", "owner"))
    again = spans.join(many, "h").where("NOT first OR NOT (doc_id <=> owner)")
    at = store(again.groupBy("doc_id", "key").agg(F.collect_set(F.expr("shiftleft(CAST(at AS BIGINT), 32) + end")).alias("at")))
    out = map_rows(docs.join(at, docs.doc_id.eqNullSafe(at.doc_id) & (docs.key == at.key), "left").select(docs.doc_id, "text", "at"), _rebuild(docs.columns), f"doc_id {id_type}, cleaned string, n_sentences int, removed array<int>")
    return out.select("doc_id", F.col("cleaned").alias("text"), "n_sentences", F.size("removed").alias("n_removed"), "removed")
