"""Resharding by minimum-cost flow: which blocks of documents move where, so that shard sizes come
near their capacities and the fewest bytes move; then only the files of changed shards are written."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks are hash buckets of texts, so equal texts move together.
BLOCKS = 8192
#: A bucket with more than this share of a shard's bytes is dealt out in PARTS by doc_id; one with
#: more than this share of its rows stays together but is numbered part by part.
HEAVY, LONG, PARTS = 0.75, 1 / 16, 256
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Shard sizes are evened out until they differ by this share of a capacity at most.
TOLERANCE = 0.001


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from sources to sinks of least total cost, by successive shortest paths.

    ``supply`` and ``demand`` have equal sums; ``cost[i][j]`` is per unit and not negative.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i in range(n):
        for j in range(m):
            add(i, n + j, min(supply[i], demand[j]), cost[i][j])
    for i in range(n):
        add(source, i, supply[i], 0)
    for j in range(m):
        add(n + j, sink, demand[j], 0)
    potential = [0] * (n + m + 2)
    while True:
        # Dijkstra on reduced costs, which stay non-negative.
        far = [float("inf")] * (n + m + 2)
        via = [-1] * (n + m + 2)
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, price = edges[e]
                reach = d + price + potential[a] - potential[b]
                if room and reach < far[b]:
                    far[b], via[b] = reach, e
                    heapq.heappush(queue, (reach, b))
        if via[sink] < 0:
            break
        for v, d in enumerate(far):
            potential[v] += d if d < float("inf") else 0
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    return [[edges[2 * (i * m + j) + 1][1] for j in range(m)] for i in range(n)]


def equal_parts(total: int, n: int) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


@dataclass
class Block:
    """Documents that move together: bucket, rows of each part of it (-1: not in parts), bytes and
    old shard."""

    bucket: int
    parts: dict[int, int]
    size: int
    old: int
    new: int = -1


def assign(blocks: list[Block], old_shards: int, new_shards: int) -> None:
    """Give every block its new shard: the flow says how many bytes go from each old shard to each
    new one, the largest blocks are dealt to the largest open amounts, and the last differences
    are evened out by moving single blocks."""
    total = sum(b.size for b in blocks)
    supply = [0] * old_shards
    for b in blocks:
        supply[b.old] += b.size
    capacity = equal_parts(total, new_shards)
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(new_shards)] for i in range(old_shards)])
    for b in sorted(blocks, key=lambda b: (-b.size, b.bucket, min(b.parts))):
        quota = flow[b.old]
        b.new = max(range(new_shards), key=lambda j: (quota[j], j == b.old))
        quota[b.new] -= b.size
    load = np.zeros(new_shards, dtype=np.int64)
    for b in blocks:
        load[b.new] += b.size
    for _ in range(4 * len(blocks)):
        high, low = int(load.argmax()), int(load.argmin())
        gap = int(load[high] - load[low])
        if gap <= TOLERANCE * total / new_shards:
            break
        # The block that halves the difference best; one that only turns it round is no help.
        able = [b for b in blocks if b.new == high and 0 < b.size < gap]
        if not able:
            break
        b = min(able, key=lambda b: (abs(gap - 2 * b.size), b.old == high, b.bucket, min(b.parts)))
        b.new = low
        load[high] -= b.size
        load[low] += b.size


def with_blocks(docs: DataFrame, old_shards: int) -> DataFrame:
    """Adds size, text_crc32, bucket, part_hash and old_shard; null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    bucket = F.pmod(F.xxhash64(text), F.lit(BLOCKS)).cast("int")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        bucket.alias("bucket"),
        F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part_hash"),
    ).withColumn("old_shard", F.pmod(F.col("bucket"), F.lit(old_shards)))


def block_table(keyed: DataFrame, new_shards: int) -> list[Block]:
    """Sizes of all blocks; at most BLOCKS rows, and PARTS for each heavy or long one, reach the driver."""
    sums = F.sum("size").alias("size"), F.count("*").alias("rows")
    whole = keyed.groupBy("bucket", "old_shard").agg(*sums).collect()
    size, rows = sum(r.size for r in whole), sum(r.rows for r in whole)
    heavy = {r.bucket for r in whole if r.size > HEAVY * size / new_shards}
    long = {r.bucket for r in whole if r.rows > LONG * rows / new_shards}
    blocks = {r.bucket: Block(r.bucket, {-1: r.rows}, r.size, r.old_shard) for r in whole}
    several = []
    if heavy | long:
        parts = keyed.where(F.col("bucket").isin(list(heavy | long))).groupBy("bucket", "part_hash").agg(*sums)
        for bucket in heavy | long:
            blocks[bucket].parts = {}
        for r in parts.collect():
            if r.bucket in heavy:
                several.append(Block(r.bucket, {r.part_hash: r.rows}, r.size, blocks[r.bucket].old))
            else:
                blocks[r.bucket].parts[r.part_hash] = r.rows
    return [b for b in blocks.values() if b.bucket not in heavy] + several


def reshard(docs: DataFrame, new_shards: int = 24, old_shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved) of every row.

    The rows lie in ``old_shards`` shards by the hash of their text; they go to ``new_shards`` of
    near equal bytes (law ``bytes``) with as few bytes moved as that takes. Equal texts share a
    shard unless there are too many of them for it. Slots number the rows of a shard without
    gaps. Null text has no bytes and the checksum of none; a null doc_id is placed by its text;
    repeated rows are placed each, those of one doc_id together. Other columns are ignored.
    """
    keyed = with_blocks(docs, old_shards)
    blocks = block_table(keyed, new_shards)
    assign(blocks, old_shards, new_shards)
    filled = [0] * new_shards
    rows = []
    for b in sorted(blocks, key=lambda b: (b.bucket, min(b.parts))):
        for part, n in sorted(b.parts.items()):
            rows.append((b.bucket, part, b.new, filled[b.new]))
            filled[b.new] += n
    plan = docs.sparkSession.createDataFrame(rows, "bucket int, part int, shard int, base long")
    split = sorted({b.bucket for b in blocks if -1 not in b.parts})
    part = F.when(F.col("bucket").isin(split), F.col("part_hash")).otherwise(-1) if split else F.lit(-1)
    inside = Window.partitionBy("bucket", "part").orderBy("doc_id", "text_crc32", "size")
    # The plan has one row per block: at most BLOCKS, and PARTS for each heavy or long one.
    out = keyed.withColumn("part", part).join(F.broadcast(plan), ["bucket", "part"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.row_number().over(inside) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
        (F.col("shard") != F.col("old_shard")).alias("moved"),
    )


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the shards that gain or lose rows below ``path``, a folder each; returns them.

    ``docs`` are the rows with a unique doc_id, ``placed`` their places. Shards that keep exactly
    their rows are not written: their files stand.
    """
    moved = placed.where("moved")
    ends = moved.select("shard").union(moved.select("old_shard")).distinct().collect()
    changed = sorted(r.shard for r in ends)
    places = placed.where(F.col("shard").isin(changed)).select(F.col("doc_id").alias("__id"), "shard", "slot")
    rows = docs.join(places, docs.doc_id == F.col("__id")).drop("__id")
    # Ranges within a shard keep files of bounded size and in order of slots.
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return changed
