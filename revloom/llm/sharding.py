"""Sharding by Karmarkar-Karp differencing: shards of near-equal bytes from groups that can't be divided.

Documents with equal texts form a group. A group with at least 1 / (shards * HEAVY) of all bytes is an
item of its own: there are at most shards * HEAVY of those, whatever the input. All other groups are
bundled by hash into BUNDLES items. The driver differences these items, at most 9,728 by default: each
is a partial partition, and the two with the largest spread are combined again and again, their parts in opposite
order, until one is left. Slots are numbered by bucket, with the counts of the buckets before.

Defined cases: a null text has no bytes, size 8 and crc32 0, and is in one group with the empty text.
Groups of one size, and parts of one sum, are ordered by their hash and position, so reruns agree. An
empty table gives no rows. Rows that repeat get different slots of one shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revloom.llm.common import store

SHARDS, HEAVY, BUNDLES = 24, 64, 8192


def differencing(sizes: list[int], parts: int) -> list[int]:
    """The part of each item, by Karmarkar-Karp differencing with `parts` parts."""
    place = [0] * len(sizes)
    nodes: list[tuple[int, int]] = []  # bin -> (left bin, right bin); a bin below -1 is the item -2 - bin
    heap = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        heap.append((-sizes[i], i, [(sizes[i], -2 - i), *[(0, -1)] * (parts - 1)]))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = []
        for (x, left), (y, right) in zip(a, reversed(b)):
            if left != -1 and right != -1:
                nodes.append((left, right))
                merged.append((x + y, len(nodes) - 1))
            else:
                merged.append((x + y, right if left == -1 else left))
        merged.sort(key=lambda z: (-z[0], z[1]))
        low = merged[-1][0]
        merged = [(x - low, k) for x, k in merged]
        heapq.heappush(heap, (-merged[0][0], order, merged))
        order += 1
    for part, (_, top) in enumerate(heap[0][2] if heap else []):
        stack = [top]
        while stack:
            k = stack.pop()
            if k < -1:
                place[-2 - k] = part
            elif k >= 0:
                stack.extend(nodes[k])
    return place


def shards(docs: DataFrame, parts: int = SHARDS, heavy: int = HEAVY, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    raw = F.coalesce("text", F.lit("")).cast("binary")
    thin = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("g"), F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 3).alias("bucket"))
    thin = store(thin)
    total = thin.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = store(thin.groupBy("g").agg(F.sum("size").alias("bytes")))
    is_heavy = F.col("bytes") * (parts * heavy) >= F.lit(total)
    large = sorted(((r.bytes, r.g) for r in groups.where(is_heavy).collect()), reverse=True)  # parts * heavy at most
    rest = sorted((r.bytes, r.b) for r in groups.where(~is_heavy).groupBy(F.pmod("g", F.lit(bundles)).alias("b")).agg(F.sum("bytes").alias("bytes")).collect())  # bundles at most
    place = differencing([x for x, _ in large] + [x for x, _ in rest], parts)
    own = spark.createDataFrame([(g, p) for (_, g), p in zip(large, place)], "g long, own int")
    shared = spark.createDataFrame([(b, p) for (_, b), p in zip(rest, place[len(large) :])], "b long, shared int")
    placed = thin.join(F.broadcast(own), "g", "left").join(F.broadcast(shared), F.pmod("g", F.lit(bundles)) == F.col("b"), "left")
    placed = placed.select("doc_id", "size", "text_crc32", "bucket", F.coalesce("own", "shared").alias("shard"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32"))
    out = placed.withColumn("rank", rank).join(starts, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
