"""Balanced shards by Karmarkar-Karp differencing.

Groups of equal texts can't be divided. Their sizes are summed in Spark, and every group that holds
more than a fixed small share of all bytes is an item of its own (there can be at most
SHARDS * FINE such groups); the others are dealt by hash into a fixed number of units, which are
items too. So the differencing runs over a bounded number of items on the driver, whatever the
corpus: each item starts as a partial partition with itself in one shard, and the two partial
partitions of largest spread are put together in opposite order until one is left.

Edge cases: null text is a group of its own with size 1 a row, apart from empty texts; repeated rows and ids
are rows of their own with their own slots; null ids stay null; an empty table gives an empty result;
other columns are ignored. Equal sizes are told apart by key, so the result doesn't depend on order.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut

SHARDS = 8
#: Groups above 1 / (shards * FINE) of all bytes are items of their own; lighter ones share UNITS items.
FINE, UNITS = 1000, 8192
#: Rows of a shard that get their slots together.
BLOCK = 200_000


def differencing(sizes: dict[object, int], shards: int) -> dict[object, int]:
    """Item to shard: the largest differencing method for any number of shards."""
    heap: list[tuple[int, int, list[tuple[int, list]]]] = []
    for n, (item, size) in enumerate(sorted(sizes.items(), key=lambda x: (-x[1], str(x[0])))):
        heap.append((-size, n, [(size, [item])] + [(0, [])] * (shards - 1)))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = []
        for (x, p), (y, q) in zip(a, reversed(b)):
            if p and q:
                p, q = (p, q) if len(p) >= len(q) else (q, p)
                p.extend(q)
            joined.append((x + y, p or q))
        joined.sort(key=lambda z: -z[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], n, joined))
        n += 1
    return {item: k for k, (_, items) in enumerate(heap[0][2]) for item in items} if heap else {}


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("key"),
    )
    rows = cut(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    unit = F.when(F.col("bytes") * shards * FINE > F.lit(total), F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(UNITS)).cast("string"))
    groups = cut(groups.select("key", "bytes", unit.alias("unit")), "groups")
    # At most shards * FINE + UNITS rows.
    sizes = {r["unit"]: r["n"] for r in groups.groupBy("unit").agg(F.sum("bytes").alias("n")).collect()}
    placed = spark.createDataFrame(list(differencing(sizes, shards).items()), "unit string, shard int")
    groups = groups.join(F.broadcast(placed), "unit").select("key", "shard")
    rows = rows.join(groups, "key")
    # Slots: numbered within blocks of about BLOCK rows, then moved by the blocks before.
    blocks = 1 + n_rows // (shards * BLOCK)
    rows = cut(rows.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(blocks * 16)).cast("int").alias("block")), "sharded")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")
    return (
        rows.withColumn("k", F.row_number().over(within) - 1).join(ahead, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("k") + F.col("ahead")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )

