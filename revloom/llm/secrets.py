"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are what the three patterns match, leftmost and not overlapping, for each kind. Beside them any run of
20 or more characters of the base64 and URL alphabets with a digit and a letter is a candidate. Candidates
and base values are hashed and aggregated over the corpus by distinct owners (the source) and repositories (the
document): a value of WIDE or more owners, or of COPIED or more repositories for each of its owners, is a widely copied example;
any other is specific to its owner and looks live. Live candidates outside the base spans become spans of the kind `owned`;
base spans stay, whatever the verdict.

Positions are code points, ends are exclusive, and come from the lengths of a text's pieces between
matches and of the matches.

Defined cases: a null text is empty and has no spans; base_sha256 is then that of the empty text. A null
source is an owner by itself. Rows that repeat are scanned each; they count as one repository if they share their
doc_id. Spans of one start are in the order of kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revloom.llm.common import store

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, CANDIDATE = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_=-]{20,}"
WIDE, COPIED = 3, 20
_SPAN = "struct<s:int,k:int,e:int,v:int,h:bigint>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _spans(pattern: str, kind: int, group: int, keep: str) -> str:
    """An expression for the array of (start, kind, end, start of the value, hash of the value) of a pattern's matches."""
    p = _quoted(pattern)
    # let x, l, b, s be arrays of one, so that each is made once a row: pieces and matches, their lengths, sums of 64 of them, sums before each 64
    pieces = f"named_struct('p', split(t, {p}), 'm', regexp_extract_all(t, {p}, 0), 'v', regexp_extract_all(t, {p}, {group}))"
    lengths = "zip_with(x.p, x.m, (a, m) -> length(a) + coalesce(length(m), 0))"
    sums = "transform(sequence(0, CAST((size(l) - 1) DIV 64 AS INT)), j -> aggregate(slice(l, j * 64 + 1, 64), 0, (n, y) -> n + y))"
    before = "aggregate(b, array(0), (acc, y) -> concat(acc, array(element_at(acc, -1) + y)))"
    start = "s[CAST(i DIV 64 AS INT)] + aggregate(slice(l, CAST((i DIV 64) * 64 + 1 AS INT), CAST(i % 64 AS INT)), 0, (n, y) -> n + y) + length(x.p[i])"
    span = "named_struct('s', at, 'k', {k}, 'e', at + length(x.m[i]), 'v', at + length(x.m[i]) - length(x.v[i]), 'h', xxhash64(x.v[i]))".format(k=kind)
    every = f"transform(sequence(0, size(x.m) - 1), i -> transform(array({start}), at -> {span})[0])"
    kept = every if keep == "true" else f"filter({every.replace(span, f'IF({keep}, {span}, NULL)')}, z -> z IS NOT NULL)"
    body = f"transform(array({pieces}), x -> transform(array({lengths}), l -> transform(array({sums}), b -> transform(array({before}), s -> {kept})[0])[0])[0])[0]"
    return f"IF(t RLIKE {p}, CAST({body} AS array<{_SPAN}>), CAST(array() AS array<{_SPAN}>))"


def _scanned(docs: DataFrame, carry: bool) -> DataFrame:
    """A row for each of docs: rid, d (the id), o (the owner), base spans, candidates; with the row itself if carried."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    t = docs.select(*row, F.col("doc_id").alias("d"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("o"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    base = f"array_sort(concat({_spans(ASSIGN, 0, 2, 'length(x.v[i]) >= 6')}, {_spans(ACCESS, 1, 0, 'true')}, {_spans(HEX, 2, 0, 'true')}))"
    plain = "x.v[i] RLIKE '[0-9]' AND x.v[i] RLIKE '[A-Za-z]'"
    t = t.selectExpr(*["row"] * carry, "d", "o", f"{base} AS base", f"{_spans(CANDIDATE, 3, 0, plain)} AS cand")
    free = F.filter("cand", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return store(t.withColumn("cand", free).withColumn("rid", F.monotonically_increasing_id()))


def _judged(scanned: DataFrame, wide: int, copied: int) -> DataFrame:
    """rid, owned (spans to add), n_live, n_example: for rows with a span or candidate."""
    values = scanned.where("size(base) + size(cand) > 0").selectExpr("rid", "d", "o", "explode(concat(base, cand)) AS x").selectExpr("rid", "d", "o", "x", "x.h AS h")
    spread = values.groupBy("h").agg(F.count_distinct("o").alias("owners"), F.count_distinct("d").alias("repositories"))
    told = values.select("rid", "x", "h").join(spread, "h").withColumn("live", (F.col("owners") < wide) & (F.col("repositories") < copied * F.col("owners")))
    base, added = F.col("x.k") < 3, (F.col("x.k") == 3) & F.col("live")
    return told.groupBy("rid").agg(F.array_sort(F.collect_list(F.when(added, F.col("x")))).alias("owned"), F.count_if(base & F.col("live")).alias("n_live"), F.count_if(base & ~F.col("live")).alias("n_example"))


def _text(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"concat_ws(',', transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.s, x.e)))"


def scan(docs: DataFrame, wide: int = WIDE, copied: int = COPIED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for each row of docs (doc_id, source, text)."""
    scanned = _scanned(docs.select("doc_id", "source", "text"), False)
    out = scanned.join(_judged(scanned, wide, copied), "rid", "left")
    spans = f"array_sort(concat(base, coalesce(owned, CAST(array() AS array<{_SPAN}>))))"
    count = [f"CAST(size(filter(base, x -> x.k = {k})) AS BIGINT) AS n_{KINDS[k]}" for k in range(3)]
    return out.selectExpr("d AS doc_id", *count, f"sha2(CAST({_text('base')} AS BINARY), 256) AS base_sha256", f"{_text(spans)} AS spans", "coalesce(n_live, 0L) AS n_live", "coalesce(n_example, 0L) AS n_example")


def redact(docs: DataFrame, wide: int = WIDE, copied: int = COPIED, mark: str = "[SECRET]") -> DataFrame:
    """docs with the values of all base and owned spans replaced by a mark; n_chars, if it is a number, follows.

    Null and empty texts stay as they are, every row and column is kept, repeated rows are masked alike, and no rows give none.
    """
    scanned = _scanned(docs, True)
    out = scanned.join(_judged(scanned, wide, copied), "rid", "left")
    spans = f"array_sort(transform(concat(base, coalesce(owned, CAST(array() AS array<{_SPAN}>))), x -> named_struct('s', x.v, 'e', x.e)))"
    rebuilt = f"""aggregate({spans}, named_struct('at', 0, 'out', ''), (acc, x) -> IF(x.e <= acc.at, acc,
        named_struct('at', x.e, 'out', concat(acc.out, IF(x.s >= acc.at, concat(substring(row.text, acc.at + 1, x.s - acc.at), '{mark}'), '')))),
        acc -> concat(acc.out, substring(row.text, acc.at + 1)))"""
    out = out.selectExpr("row", f"IF(size(base) + coalesce(size(owned), 0) = 0, row.text, {rebuilt}) AS cleaned")
    changed = {"text": "cleaned", "n_chars": "IF(row.text <=> cleaned, row.n_chars, CAST(length(cleaned) AS BIGINT))"}
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.simpleString() not in ("bigint", "int"):
        del changed["n_chars"]
    return out.selectExpr(*[f"{changed.get(c, f'row.`{c}`')} AS `{c}`" for c in docs.columns])
