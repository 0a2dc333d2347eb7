"""MinHash near-duplicates by a chosen-path set similarity join.

Every document's word shingles give a set; equal sets are collapsed first. The distinct sets are then
branched into trees of nodes by minwise tokens: a node is a path of (hash function, minimum) choices,
and which functions a node branches on follows from its path alone, so that two sets which share a node
choose the same ones. Nodes of at most SMALL sets are compared exhaustively: a 128-bit sketch filters the pairs,
and what passes is confirmed on full sets.

The sets of a larger node are compared with its centre, the set nearest to the sketch that most of the node agree on: in a group
of near copies it is near the text the copies were made from, and most copies are linked to it directly. How far a set
is from the centre by the sketch says where the set goes on:

* nearer than CORE: only into the children in whose token it differs from the centre, since links among sets that share the
  centre's tokens go through the centre;
* farther than RING: no link of it reaches a set within CORE; it goes on into CHILDREN children, whatever the token;
* between them: into one child whatever the token, and into those in whose token it differs.

So a group of near copies costs a star, and the links that its centre doesn't explain are found where its sets differ from
it, in smaller nodes. Nodes of at most LOCAL sets are
branched on to the end by one task, on sketches; larger ones level by level across the cluster, until none is left. After LEVELS levels,
which no input has been seen to reach, a task compares a node exhaustively whatever its size, and a node of over LOCAL sets is an error.

What sketches call near makes clusters. All sets of a cluster of at most BLOCK sets and SHINGLES shingles are compared with each other on full
sets, each shipped once, by one task. In larger clusters candidate pairs are confirmed in two rounds: each set with the nearest and the nearest centre first, then those
that aren't in one component yet. In the second round a set near a component of more than SMALL is also compared with its CENTRES exact centres:
the members nearest to the shingles that most members have, among which is the text that all others were made from, if it is there.
At last all sets outside a cluster's largest component are compared with all of the cluster, in blocks of BLOCK sets: first sketches, then
the full sets of those that are near a set of another component. So a cluster loses no link that the sketch doesn't; the work grows with
the size of the cluster times the number of sets outside its largest component.

Recall: a pair with similarity 0.8 shares at least one of TREES = 8 roots but for 0.2^8 = 3e-6, and the sketch loses a pair
with 1e-5. In nodes of at most SMALL, and of two sets of one cluster, that is all. In larger nodes the sets nearer than FAR to the centre, whose size
is near its own, are one cluster; of others, two farther than CORE from the centre share a child with probability 0.96, and of a pair with a set within CORE no bound is proven. tests/llm hold the components against brute force on groups of near
copies, of ever shorter copies and of texts made from few frequent lines; README has where links are lost.

A class of equal sets is told by two 64-bit sums and the size, and links are tested on 64-bit hashes of shingles, not on their words.

Defined cases: null or empty text, or one without words: no shingles, linked with nothing, component_id
is its own doc_id and it is kept. Rows that repeat (same or other doc_id, same set) are one component,
of which every row with the smallest doc_id is kept. A null doc_id never is the smallest unless alone.
Columns other than the id and text are dropped here; keep_first() retains them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revloom.llm import shingles as S
from revloom.llm.common import components, discard, map_rows, store

TREES, SMALL, VOTES, CENTRES, CHILDREN, WIDE, CORE, FAR, RING, LEVELS = 8, 128, 64, 4, 2, 8, 20, 31, 36, 40
BLOCK, SHINGLES = 1024, 1 << 22  # so many sets and shingles of a cluster are compared in one task
LOCAL = 8192  # so many sets of a node are branched on in one task
FEW = 2_000_000  # so many ids at most are broadcast


def _sketches(k: int):
    def make(batches):
        for b in batches:
            out = {c: [] for c in ("doc_id", "n_shingles", "d1", "d2", "b1", "b2", "sig")}
            for i, text in zip(b["doc_id"], b["text"]):
                s = S.shingle_set(text, k)
                d, sig = S.digest(s), S.signature(s) if len(s) else np.zeros(0, np.uint32)
                two = S.bits(sig) if len(s) else (0, 0)
                for c, v in zip(out, (i, len(s), *d, *two, sig.view(np.int32))):
                    out[c].append(v)
            yield out

    return make


def _sets(k: int):
    def make(batches):
        for b in batches:
            out = {c: [] for c in ("d1", "d2", "n_shingles", "items")}
            for text in b["text"]:
                s = S.shingle_set(text, k)
                for c, v in zip(out, (*S.digest(s), len(s), s.view(np.int64))):
                    out[c].append(v)
            yield out

    return make


def _full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(cid, items): the full sets of the class ids in ids (cid), made again from one document of each class."""
    wanted = store(classes.join(ids.distinct(), "cid", "left_semi"))
    low = wanted.select(F.col("low")).distinct()
    if wanted.count() <= FEW:
        low = F.broadcast(low)
    found = map_rows(docs.join(low, docs.doc_id.eqNullSafe(low.low), "left_semi").select("text"), _sets(k), "d1 long, d2 long, n_shingles long, items array<long>")
    return store(found.join(wanted.select("d1", "d2", "n_shingles", "cid"), ["d1", "d2", "n_shingles"]).dropDuplicates(["cid"]).select("cid", "items"))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of class ids whose full sets are similar enough."""
    both = pairs.join(sets.selectExpr("cid AS a", "items AS ia"), "a").join(sets.selectExpr("cid AS b", "items AS ib"), "b")
    both = both.selectExpr("a", "b", "CAST(size(array_intersect(ia, ib)) AS BIGINT) AS i", "CAST(size(ia) + size(ib) AS BIGINT) AS t")
    return both.where(f"100 * i >= {percent} * (t - i)").select("a", "b")


def forest(items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(first, other) for each set that links join to an earlier one; first is the smallest index of its component."""
    n, size = len(items), np.array([len(x) for x in items])
    value, column, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    common = count[column] > 1
    row, column = row[common], (np.cumsum(count > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [lo, lo + 8192])
        m = np.zeros((n, 8192), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        shared += m @ m.T
    link = 100 * shared.astype(np.int64) >= percent * (size[:, None] + size[None] - shared.astype(np.int64))
    out, left = [], np.ones(n, bool)
    for i in range(n):
        if left[i]:
            left[i], edge = False, [i]
            while edge:
                near = np.flatnonzero(link[edge.pop()] & left)
                left[near] = False
                out.extend((i, int(x)) for x in near)
                edge.extend(near.tolist())
    return out


def _majority(bits: str) -> str:
    """64 bits, each as most of the sketches in ps have it."""
    ones = f"aggregate(ps, 0, (n, p) -> n + CAST(shiftrightunsigned(p.{bits}, i) & 1 AS INT))"
    return f"aggregate(transform(sequence(0, 63), i -> IF(2 * {ones} > size(ps), shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)"


def _centres(big: DataFrame, sig: DataFrame) -> DataFrame:
    """(node, mc, mn, m1, m2, tokens): of about VOTES sets of each node, picked by hash, the one nearest to the sketch that most of them agree on."""
    votes = big.where(f"pmod(xxhash64(node, cid), m) < {VOTES}").groupBy("node").agg(F.collect_list(F.struct("cid", "n_shingles", "b1", "b2")).alias("ps"))
    middle = f"named_struct('c1', {_majority('b1')}, 'c2', {_majority('b2')})"
    # over an array of one, so that the sketch is made once a node; ties go by the id's hash alone, so that the same set is the centre in many nodes
    nearest = f"transform(array({middle}), c -> array_min(transform(ps, p -> named_struct('far', bit_count(p.b1 ^ c.c1) + bit_count(p.b2 ^ c.c2), 'h', xxhash64(p.cid), 'p', p))))[0]"
    best = votes.selectExpr("node", f"{nearest} AS x").selectExpr("node", "x.p AS p")
    best = best.selectExpr("node", "p.cid AS cid", "p.n_shingles AS mn", "p.b1 AS m1", "p.b2 AS m2")
    return store(best.join(sig, "cid").selectExpr("node", "cid AS mc", "mn", "m1", "m2", f"transform(sequence(0, {WIDE - 1}), j -> {_token('j')}) AS tokens"))


def _exact_centres(roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(root, mc): CENTRES members of each large component nearest to the shingles that most of about VOTES members have."""
    member = store(roots.union(roots.select("root", "root")).toDF("cid", "root").distinct())
    large = member.groupBy("root").agg(F.count("*").alias("n")).where(f"n > {SMALL}")
    full = store(member.join(large, "root").join(sets, "cid"))
    votes = full.where(f"pmod(xxhash64(root, cid), n) < {VOTES}")
    common = votes.selectExpr("root", "explode(items) AS x").groupBy("root", "x").agg(F.count("*").alias("c")).join(votes.groupBy("root").agg(F.count("*").alias("v")), "root").where("2 * c > v")
    core = store(common.groupBy("root").agg(F.collect_list("x").alias("core")))  # at most twice as many as such a set has
    far = full.join(core, "root").selectExpr("root", "cid", "shiftleft(CAST(size(items) + size(core) - 2 * size(array_intersect(items, core)) AS BIGINT), 40) + pmod(xxhash64(cid), 1099511627776) AS far")
    far = store(far)
    best = far.groupBy("root").agg(*[F.min(F.expr(f"IF(pmod(far, {CENTRES}) = {j}, far, NULL)")).alias(f"f{j}") for j in range(CENTRES)])
    out = store(far.join(best, "root").where(" OR ".join(f"far = f{j}" for j in range(CENTRES))).selectExpr("root", "cid AS mc"))
    discard(member, full, core, far)
    return out


def _token(j: str) -> str:
    """The minimum that a set has by the j-th function of a node."""
    return f"sig[CAST(pmod(xxhash64(node, {j}, 'at'), {S.FUNCTIONS}) AS INT)]"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _branched(percent: int):
    """Pairs of a node of at most LOCAL sets, which one task branches on to the end."""

    def make(group):
        import pandas as pd

        cid, n = group["cid"].to_numpy(), group["n_shingles"].to_numpy()
        bits = group[["b1", "b2"]].to_numpy(np.int64).view(np.uint64)
        sig = np.stack(group["sig"].to_numpy())
        out = []

        def emit(i, j, d, star):
            ok = (d <= FAR) & (cid[i] != cid[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = cid[i[ok]], cid[j[ok]]
            out.append((np.minimum(i, j), np.maximum(i, j), d[ok], np.full(len(i), star)))

        todo = [(np.arange(len(cid)), int(group["node"].iloc[0]) & 0xFFFFFFFF, 1)]
        while todo:
            at, path, depth = todo.pop()
            if len(at) <= SMALL or depth == LEVELS:
                for k in range(0, len(at), 1024):
                    d = np.bitwise_count(bits[at[k : k + 1024], None] ^ bits[None, at]).sum(-1, dtype=np.int64)
                    i, j = np.nonzero((d <= FAR) & (np.arange(k, k + len(d))[:, None] < np.arange(len(at))))
                    emit(at[i + k], at[j], d[i, j], False)
                continue
            rng = np.random.default_rng([path, depth])
            votes = bits[rng.choice(at, VOTES, replace=False)].view(np.uint8)
            middle = np.packbits(2 * np.unpackbits(votes, axis=1).sum(0, dtype=np.int64) > VOTES).view(np.uint64)
            centre = at[np.lexsort((cid[at], np.bitwise_count(bits[at] ^ middle).sum(-1, dtype=np.int64)))[0]]
            d = np.bitwise_count(bits[at] ^ bits[centre]).sum(-1, dtype=np.int64)
            emit(at, np.full(len(at), centre), d, True)
            always = np.where(d <= CORE, 0, np.where(d <= RING, 1, CHILDREN))
            for j, f in enumerate(rng.choice(S.FUNCTIONS, WIDE, replace=False)):
                v = sig[at, f]
                goes = np.flatnonzero((j < always) | (d <= RING) & (v != sig[centre, f]))
                goes = goes[np.argsort(v[goes], kind="stable")]
                cut = np.flatnonzero(np.concatenate([[True], v[goes][1:] != v[goes][:-1], [True]]))
                for a, b in zip(cut[:-1], cut[1:]):
                    if b - a > 1:
                        todo.append((at[goes[a:b]], (path * 31 + int(v[goes[a]]) % 65521 * 17 + j) % (1 << 61), depth + 1))
        a, b, d, star = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return pd.DataFrame({"a": a, "b": b, "d": d.astype(np.int32), "star": star.astype(bool)}).drop_duplicates()

    return make


def _candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, d, star) of class ids, a < b, at a sketch distance d of at most FAR: of small nodes, and of larger ones' sets with their centre (star)."""
    sig, look = reps.select("cid", "sig"), reps.select("cid", "n_shingles", "b1", "b2")
    rows = sig.selectExpr("cid", f"posexplode(slice(sig, 1, {TREES})) AS (f, v)").selectExpr("xxhash64(f, v) AS node", "cid")
    levels, found, kept = [], [], []
    alike = f"100 * least({{0}}, {{1}}) >= {percent} * greatest({{0}}, {{1}})"
    for depth in range(1, LEVELS + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        level = store(rows.join(sizes, "node").join(look, "cid"))
        kept.append(level)
        levels.append(level)
        big = level.where(f"m > {LOCAL}")
        if big.isEmpty():
            break
        centres = _centres(big, sig)
        told = store(big.join(centres, "node").selectExpr("node", "cid", "n_shingles", "mc", "mn", "tokens", "bit_count(b1 ^ m1) + bit_count(b2 ^ m2) AS d"))
        kept += [centres, told]
        found.append(told.where(f"d <= {FAR} AND cid <> mc AND {alike.format('n_shingles', 'mn')}").selectExpr("least(cid, mc) AS a", "greatest(cid, mc) AS b", "d", "TRUE AS star"))
        if depth == LEVELS:
            raise RuntimeError(f"a node of over {LOCAL} sets at level {LEVELS}")
        goes = f"x.j < CASE WHEN d <= {CORE} THEN 0 WHEN d <= {RING} THEN 1 ELSE {CHILDREN} END OR (d <= {RING} AND x.v <> tokens[x.j])"
        child = f"transform(filter(transform(sequence(0, {WIDE - 1}), j -> named_struct('j', j, 'v', {_token('j')})), x -> {goes}), x -> xxhash64(node, x.j, x.v))"
        rows = store(told.join(sig, "cid").selectExpr(f"explode({child}) AS node", "cid"))
        kept.append(rows)
    every = _union(levels)
    some, far = every.where(f"m <= {SMALL}"), "bit_count(x.b1 ^ y.b1) + bit_count(x.b2 ^ y.b2)"
    near = F.expr(f"x.node = y.node AND x.cid < y.cid AND {far} <= {FAR} AND {alike.format('x.n_shingles', 'y.n_shingles')}")
    found.append(some.alias("x").join(some.alias("y"), near).selectExpr("x.cid AS a", "y.cid AS b", f"{far} AS d", "FALSE AS star"))
    medium = every.where(f"m > {SMALL} AND m <= {LOCAL}").join(sig, "cid")
    found.append(medium.groupBy("node").applyInPandas(_branched(percent), "a long, b long, d int, star boolean"))
    out = store(_union(found).groupBy("a", "b").agg(F.min("d").alias("d"), F.max("star").alias("star")))
    discard(*kept)
    return out


def _within(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, root) by comparing all sets of each cluster (cid, root), at most BLOCK of them, in one task a cluster."""

    def compare(group):
        import pandas as pd

        group = group.sort_values("cid")
        cid = group["cid"].to_numpy()
        links = forest(group["items"].tolist(), percent)
        return pd.DataFrame({"id": [cid[y] for _, y in links], "root": [cid[x] for x, _ in links]}, dtype="int64")

    return member.select("cid", "root").join(sets, "cid").groupBy("root").applyInPandas(compare, "id long, root long")


def _crossed(percent: int):
    """Of sets and those outside the largest component (odd), who has to be compared on full sets: near ones of two components."""

    def make(group):
        odd = group["odd"].to_numpy(bool)
        x, y = group[odd], group[~odd]
        far = sum(np.bitwise_count(x[c].to_numpy()[:, None] ^ y[c].to_numpy()).astype(np.int64) for c in ("b1", "b2"))
        n, m = x["n_shingles"].to_numpy()[:, None], y["n_shingles"].to_numpy()
        ok = (far <= FAR) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (x["top"].to_numpy()[:, None] != y["top"].to_numpy())
        keep = odd.copy()
        keep[odd], keep[~odd] = ok.any(1), ok.any(0)
        return group.loc[keep, ["cluster", "i", "j", "odd", "cid", "top"]]

    return make


def _linked(percent: int):
    """(a, b) of the components that links join between the sets of a group and its odd ones."""

    def make(group):
        import pandas as pd

        odd = group["odd"].to_numpy(bool)
        x, y = group[odd], group[~odd]
        sides = [(g["items"].tolist(), np.array([len(i) for i in g["items"]], np.int64)) for g in (x, y)]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        flat = [np.concatenate(items) for items, _ in sides]
        both = np.intersect1d(*flat)
        at = []
        for f, (_, size) in zip(flat, sides):
            row, known = np.repeat(np.arange(len(size)), size), np.isin(f, both)
            column = np.searchsorted(both, f[known])
            order = np.argsort(column, kind="stable")
            at.append((row[known][order], column[order]))
        shared = np.zeros((len(x), len(y)), np.float32)
        for lo in range(0, len(both), 8192):
            part = []
            for (row, column), n in zip(at, shared.shape):
                a, b = np.searchsorted(column, [lo, lo + 8192])
                m = np.zeros((n, min(8192, len(both) - lo)), np.float32)
                m[row[a:b], column[a:b] - lo] = 1
                part.append(m)
            shared += part[0] @ part[1].T
        common = shared.astype(np.int64)
        i, j = np.nonzero(100 * common >= percent * (sides[0][1][:, None] + sides[1][1] - common))
        pairs = pd.DataFrame({"a": x["top"].to_numpy()[i], "b": y["top"].to_numpy()[j]}, dtype="int64")
        return pairs[pairs.a != pairs.b].drop_duplicates()

    return make


def _between(part: DataFrame, look: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the components that links join within the clusters of part (cid, cluster, top).

    All sets outside a cluster's largest component are compared with all of the cluster, a block by a block in a task:
    first sketches, then the full sets of those that are near one of another component.
    """
    per = store(part.join(look, "cid"))
    tops = per.groupBy("cluster", "top").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).groupBy("cluster")
    deal = tops.agg(F.max(F.struct("n", "top", "s")).alias("x"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > x.n")
    blocks = f"CAST(ceil(greatest(({{0}}) / {BLOCK}, ({{1}}) / {SHINGLES})) AS INT)"
    deal = deal.selectExpr("cluster", "x.top AS most", f"{blocks.format('n - x.n', 's - x.s')} AS k", f"{blocks.format('n', 's')} AS m")
    per, stored = per.join(deal, "cluster"), per
    columns = ["cluster", "cid", "top", "n_shingles", "b1", "b2"]
    every = per.selectExpr(*columns, "FALSE AS odd", "explode(sequence(0, k - 1)) AS i", "CAST(pmod(xxhash64(cid), m) AS INT) AS j")
    odd = per.where("top <> most").selectExpr(*columns, "TRUE AS odd", "CAST(pmod(xxhash64(cid), k) AS INT) AS i", "explode(sequence(0, m - 1)) AS j")
    keys = ["cluster", "i", "j"]
    near = store(every.union(odd).groupBy(*keys).applyInPandas(_crossed(percent), "cluster long, i int, j int, odd boolean, cid long, top long"))
    out = store(near.join(sets, "cid").groupBy(*keys).applyInPandas(_linked(percent), "a long, b long").distinct())
    discard(stored, near)
    return out


def _among(pairs: DataFrame, member: DataFrame, look: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, root) of the clusters member (cid, root): by the links among the pairs (a, b, d, star), in two rounds, then by all others."""
    both = pairs.union(pairs.selectExpr("b", "a", "d", "star"))
    nearest = both.groupBy("a", "star").agg(F.min_by("b", "d").alias("b")).selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    roots = components(_similar(nearest, sets, percent))
    of = lambda c: roots.selectExpr(f"id AS {c}", f"root AS r{c}")
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").selectExpr("a", "b", "coalesce(ra, a) AS ra", "coalesce(rb, b) AS rb").where("ra <> rb")
    rest = store(rest)
    # the large components' exact centres, for all that is near any member of them
    exact = _exact_centres(roots, sets).withColumnRenamed("root", "rb")
    near = rest.select("a", "ra", "rb").union(rest.selectExpr("b", "rb", "ra")).distinct().join(exact, "rb").selectExpr("a", "mc", "ra", "rb")
    again = store(rest.union(near).distinct())
    more = components(_similar(again.select("a", "b"), sets, percent).join(again, ["a", "b"]).selectExpr("ra AS a", "rb AS b"))
    every = roots.union(roots.select("root", "root")).union(more.selectExpr("id", "id AS root")).groupBy("id").agg(F.min("root").alias("root"))
    found = every.join(more.selectExpr("id AS root", "root AS top"), "root", "left").selectExpr("id AS cid", "coalesce(top, root) AS top")
    part = store(member.join(found, "cid", "left").selectExpr("cid", "root AS cluster", "coalesce(top, cid) AS top"))
    last = components(_between(part, look, sets, percent))
    out = store(part.join(last.selectExpr("id AS top", "root"), "top", "left").selectExpr("cid AS id", "coalesce(root, top) AS root"))
    discard(rest, again, part)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketches = map_rows(docs, _sketches(k), f"doc_id {id_type}, n_shingles long, d1 long, d2 long, b1 long, b2 long, sig array<int>")
    sk = store(sketches.withColumn("rid", F.monotonically_increasing_id()))
    keys = ["d1", "d2", "n_shingles"]
    classes = store(sk.where("n_shingles > 0").groupBy(*keys).agg(F.min("rid").alias("cid"), F.min("doc_id").alias("low")))
    reps = store(sk.join(classes.select("cid"), F.col("rid") == F.col("cid")).select("cid", "n_shingles", "b1", "b2", "sig"))
    pairs = _candidates(reps, percent)
    clusters = components(pairs.select("a", "b"))
    member = store(clusters.union(clusters.select("root", "root").distinct()).toDF("cid", "root").join(classes.select("cid", "n_shingles"), "cid"))
    sizes = member.groupBy("root").agg((F.count("*") > BLOCK).alias("many"), (F.sum("n_shingles") > SHINGLES).alias("long")).selectExpr("root", "many OR long AS large")
    dealt = store(member.join(sizes, "root").select("cid", "root", "large"))
    sets = _full_sets(docs, classes, dealt.select("cid"), k)
    roots = _within(dealt.where("NOT large"), sets, percent)
    rest = store(pairs.join(dealt.where("large").selectExpr("cid AS a"), "a", "left_semi"))
    if not rest.isEmpty():
        roots = roots.union(_among(rest, dealt.where("large").select("cid", "root"), reps.select("cid", "n_shingles", "b1", "b2"), sets, percent))
    named = classes.join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = store(named.join(least, "root").select(*keys, "component_id"))
    discard(pairs, reps, member, dealt, sets, rest, classes)
    out = sk.select("doc_id", *keys).join(named, keys, "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that another document with a smaller id stands for.

    Rows that share a doc_id are one document: they stay or go together. Rows without an id, and rows without words, stay; an empty table stays empty.
    """
    gone = near_duplicates(docs, k, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
