"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns VNODES points of a ring; a key belongs to the first point at
or after its own position.  No shard takes more than
ceil((1 + slack) * keys / shards) keys: keys are inserted clockwise from 0, and
one that finds its shard full goes on to the next point of a shard with room.

Only the number of keys on each arc reaches the driver (shards * VNODES
numbers, whatever the size of the data).  Filling the arcs there gives ranges
of ranks, and each key finds its shard by its rank on its arc.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS = 64
VNODES = 128
SLACK = 0.05


def _place(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shards) of the points in clockwise order; the shard breaks ties."""
    points = sorted((_place(f"{s}#{v}"), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def fill(counts: np.ndarray, owner: np.ndarray, capacity: int, shards: int) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, last rank + 1, shard) when ``counts`` keys an arc are inserted clockwise."""
    room = np.full(shards, capacity, np.int64)
    n, out = len(owner), []
    nxt = list(range(n))  # the next point with room at or after each, shortened as shards fill

    def open_at(a: int) -> int:
        path = []
        while True:
            while nxt[a] != a:
                path.append(a)
                a = nxt[a]
            if room[owner[a]] > 0:
                break
            path.append(a)
            a = nxt[a] = (a + 1) % n
        for p in path:
            nxt[p] = a
        return a

    for arc in np.flatnonzero(counts).tolist():
        lo, end = 0, int(counts[arc])
        while lo < end:
            s = int(owner[open_at(arc)])
            k = min(end - lo, int(room[s]))
            out.append((arc, lo, lo + k, s))
            room[s] -= k
            lo += k
    return out


def assign(keys: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """Shard of each distinct doc_id: doc_id, home_shard, shard.

    A null id is one key (with the position of an empty name); ids that occur
    in several rows are one key, so their rows stay together.  Other columns
    are not read.  An empty table gives an empty result.
    """
    spark = keys.sparkSession
    if shards < 1 or vnodes < 1 or slack < 0:
        raise ValueError("shards and vnodes must be at least 1 and slack at least 0")
    points, owner = ring(shards, vnodes)

    def locate(batches):
        for b in batches:
            at = np.searchsorted(points, b.column("place").to_numpy(), "left") % len(points)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(at.astype(np.int32))], ["doc_id", "place", "arc"])

    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    arcs = keys.select("doc_id").distinct().select("doc_id", place.alias("place")).mapInArrow(locate, "doc_id long, place long, arc int")
    counts = np.zeros(len(points), np.int64)
    for r in arcs.groupBy("arc").count().collect():  # one row an arc of the ring
        counts[r["arc"]] = r["count"]
    capacity = ceil((1 + slack) * int(counts.sum()) / shards)
    moves = fill(counts, owner, capacity, shards)
    table = spark.createDataFrame(pa.table([pa.array([m[i] for m in moves], pa.int64()) for i in range(4)], ["arc", "lo", "hi", "shard"]))
    home = spark.createDataFrame(pa.table([pa.array(range(len(owner)), pa.int64()), pa.array(owner)], ["arc", "home_shard"]))
    # both tables have a row or two an arc: their size is that of the ring
    ranges = table.join(home, "arc").groupBy("arc", "home_shard").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("parts"))
    ranked = arcs.withColumn("rank", F.row_number().over(W.partitionBy("arc").orderBy("place", "doc_id")) - 1)
    placed = ranked.join(F.broadcast(ranges), "arc")
    shard = F.element_at(F.filter("parts", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), 1)["shard"]
    return placed.select("doc_id", F.col("home_shard").cast("int"), shard.cast("int").alias("shard"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
