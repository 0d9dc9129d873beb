"""Sharding: longest-processing-time scheduling of groups that must stay together.

Rows with equal texts form a group; a group's size is the sum of its rows' sizes. Groups are sorted by size, largest
first, and each goes to the least-loaded shard, taken from a heap.

Groups of one size are all alike to this law, so the driver needs only how many groups each size has: sizes that
differ and add up to no more than B bytes are no more than sqrt(2 B) many, about 250,000 for 30 GB, whatever the
number of groups. For a size with many groups the heap's choices are counted without making them one by one. A group
then takes the shard of its place among the groups of its size.

Rows never meet in one task: group sizes are pre-aggregated; groups of one size are numbered in buckets of about
BUCKET, dealt by hash; rows are numbered in the parts in which they are written, so that equal rows need not meet.

Defined results: null texts have size 1, checksum 0 and one group of their own; rows that are equal in all
columns keep one slot each; an empty table gives an empty table; columns that are named like the results are
replaced, all others stay, whatever their names. Shards are the same in each run, slots needn't be.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import written

#: Groups of one size that are numbered together.
BUCKET = 1 << 16
#: Sizes with more groups than this for each shard are counted, not dealt one by one.
ONE_BY_ONE = 64
#: A plan with more sizes than this is joined, not broadcast.
BROADCAST_SIZES = 1 << 17
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def dealt_counts(loads: list[int], size: int, groups: int) -> list[int]:
    """How many of these groups of one size each shard gets, if each goes to the least-loaded shard, the first of equal ones."""
    # Shard s takes its groups at loads[s], loads[s] + size, ...: the smallest of all these loads are used.
    below = lambda limit: [max(0, -(-(limit - load) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * (groups + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= groups else (low, middle)
    counts = below(low)
    for s, load in enumerate(loads):
        if sum(counts) < groups and load + counts[s] * size == low:
            counts[s] += 1
    return counts


def longest_first(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """sizes: (size, groups). For each size the number of groups up to and with each shard, by a heap of (load, shard)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, groups in sorted(sizes, reverse=True):
        counts = [0] * shards
        if groups <= ONE_BY_ONE * shards:
            for _ in range(groups):
                load, s = heap[0]
                counts[s] += 1
                heapq.heapreplace(heap, (load + size, s))
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            counts = dealt_counts(loads, size, groups)
            heap = [(load + size * n, s) for s, (load, n) in enumerate(zip(loads, counts))]
            heapq.heapify(heap)
        out[size] = np.cumsum(counts).tolist()
    return out


def shard_rows(docs: DataFrame, shards: int = 8, keep: list[str] | None = None) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard; needs doc_id and text.

    keep: which columns of docs to return besides, by default all; those left out aren't written or shuffled.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    # Columns go by their place, so that a dot in a name isn't taken for a path.
    docs = docs.select("text", *[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(kept)])
    rows = written(
        docs.select(
            F.struct(*[f"c{k}" for k in range(len(kept))] or [F.lit(0).alias("none")]).alias("row"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.xxhash64(F.col("text").isNull(), "text").alias("group"),
        )
    )
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes")))
    sizes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()]  # sqrt(2 * all bytes) rows at most
    plan = longest_first(sizes, shards)
    table = pa.table(
        {
            "bytes": pa.array([s for s, _ in sizes], pa.int64()),
            "buckets": pa.array([-(-n // BUCKET) for _, n in sizes], pa.int64()),
            "upto": pa.array([plan[s] for s, _ in sizes], pa.list_(pa.int64())),
        }
    )
    of_size = spark.createDataFrame(table) if sizes else spark.createDataFrame([], "bytes long, buckets long, upto array<long>")
    of_size = F.broadcast(of_size) if len(sizes) <= BROADCAST_SIZES else written(of_size)
    placed = written(groups.join(of_size, "bytes").withColumn("bucket", F.pmod("group", "buckets")))
    # Groups before a bucket; sizes of one bucket need no offset.
    counts = placed.filter("buckets > 1").groupBy("bytes", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bytes").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("bytes", "bucket", before.alias("first"))
    number = F.row_number().over(Window.partitionBy("bytes", "bucket").orderBy("group"))
    numbered = placed.withColumn("n", number).join(offsets, ["bytes", "bucket"], "left").withColumn("n", F.col("n") + F.coalesce("first", F.lit(0)))
    of_group = written(numbered.select("group", F.size(F.filter("upto", lambda last: last < F.col("n"))).alias("shard")))
    # Each row's part and its place there are written with it, so that counts and slots speak of the same parts.
    dealt = written(rows.join(of_group, "group").select("row", "size", "crc", "shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    parts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place"))
    slots = dealt.withColumn("inside", inside).join(parts.select("shard", "part", first.alias("first")), ["shard", "part"])
    results = {
        "size": F.col("size"),
        "text_crc32": F.col("crc"),
        "law": F.lit("bytes"),
        "shard": F.col("shard"),
        "slot": F.col("first") + F.col("inside") - 1,
        "grown_shard": F.lit(None).cast("int"),
    }
    return slots.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(kept)], *[column.alias(name) for name, column in results.items()])
