"""Exact nearest binary codes by incremental multi-index hashing.

A code is the signs of an embedding in 64-bit words.  It is cut into segments,
each with its own table.  A query probes one more segment at a time at a growing
radius; after segments 0..j at radius r (of m segments) every code within
m * r + j bits has been met, so a query ends when its kth verified distance is
no more than that.  When the next radius has more probes than there are codes,
the codes left are compared directly, which also ends it.

The queries are a stated part of the rows.  Equal codes are searched once, and
of the rows of one code only the k + 1 of least id can be among the k nearest
of anything, so a code that very many rows share costs k + 1 rows.  Codes are
packed into blocks; a task searches one block of queries in the tables of one
block of codes, and the best of all blocks are merged.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm._shared import Scratch

K = 10
#: Ids that are multiples of this are the queries of op8_topk.
EVERY = 20
INDEX_BLOCK = 1 << 18
QUERY_BLOCK = 1 << 16


@lru_cache(maxsize=64)
def _flips(bits: int, r: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)], np.int64)


class Tables:
    """One table a segment over a block of codes (rows of 64-bit words)."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        self.codes, self.ids = codes, ids
        # segments of about log2(n) bits, none across two words
        width = min(16, max(4, int(np.log2(max(2, len(codes))))))
        m = -(-64 // width)
        cut = [64 * i // m for i in range(m + 1)]
        self.segments = [(w, a, b) for w in range(codes.shape[1]) for a, b in zip(cut, cut[1:])]
        self.tables = []
        for j in range(len(self.segments)):
            v = self.part(codes, j)
            order = np.argsort(v, kind="stable")
            self.tables.append((order, np.searchsorted(v[order], np.arange((1 << self.bits(j)) + 1))))

    def bits(self, j: int) -> int:
        _, a, b = self.segments[j]
        return b - a

    def part(self, codes: np.ndarray, j: int) -> np.ndarray:
        w, a, b = self.segments[j]
        return ((codes[:, w] >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def search(self, q: np.ndarray, k: int, hold: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """(distance, id) of the k nearest rows of each query, ties by id; distance -1 where there are fewer."""
        far = np.iinfo(np.int64).max
        dist, near = np.full((len(q), k), far), np.full((len(q), k), far)
        m = len(self.segments)
        active = np.arange(len(q))
        for r in range(max(self.bits(j) for j in range(m)) + 1):
            for j in range(m):
                masks = _flips(self.bits(j), r) if r <= self.bits(j) else np.zeros(0, np.int64)
                if len(active) and len(masks) > len(self.codes):
                    self._scan(q, active, dist, near, hold)
                    active = active[:0]
                if not len(active):
                    return np.where(dist == far, -1, dist), near
                if len(masks):
                    step = max(1, hold // (4 * len(masks)))
                    for lo in range(0, len(active), step):
                        self._probe(q, active[lo : lo + step], j, r, masks, dist, near, hold)
                active = active[dist[active, k - 1] > m * r + j]
        return np.where(dist == far, -1, dist), near

    def _probe(self, q, some, j, r, masks, dist, near, hold) -> None:
        order, start = self.tables[j]
        v = (self.part(q[some], j)[:, None] ^ masks[None, :]).ravel()
        size = start[v + 1] - start[v]
        hit = np.flatnonzero(size)
        who, at, size = some[hit // len(masks)], start[v[hit]], size[hit]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(hit):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + hold, "right")))
            s = size[lo:hi]
            query = np.repeat(who[lo:hi], s)
            code = order[np.repeat(at[lo:hi] - (ends[lo:hi] - s - base), s) + np.arange(ends[hi - 1] - base)]
            x = q[query] ^ self.codes[code]
            d = np.bitwise_count(x).sum(1, dtype=np.int64)
            fit = d <= dist[query, -1]
            query, code, x, d = query[fit], code[fit], x[fit], d[fit]
            # met before: another segment within an earlier step
            new = np.ones(len(d), bool)
            for i in range(len(self.segments)):
                if i != j:
                    new &= np.bitwise_count(self.part(x, i)) >= r + (i < j)
            self._keep(query[new], d[new], self.ids[code[new]], dist, near)
            lo = hi

    def _scan(self, q, some, dist, near, hold) -> None:
        dist[some] = near[some] = np.iinfo(np.int64).max
        step = max(1, hold // max(1, self.codes.size))
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            d = np.bitwise_count(q[part][:, None] ^ self.codes[None]).sum(2, dtype=np.int64)
            self._keep(np.repeat(part, len(self.codes)), d.ravel(), np.tile(self.ids, len(part)), dist, near)

    def _keep(self, query, d, ids, dist, near) -> None:
        if not len(query):
            return
        k = dist.shape[1]
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, k)])
        d = np.concatenate([d, dist[touched].ravel()])
        ids = np.concatenate([ids, near[touched].ravel()])
        order = np.lexsort((ids, d, query))
        query, d, ids = query[order], d[order], ids[order]
        first = np.searchsorted(query, touched)
        at = first[:, None] + np.arange(k)
        dist[touched], near[touched] = d[at], ids[at]


def codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code): bit i of the code (little-endian words) says whether component i is above 0."""
    whole = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    longest = whole.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = 8 * max(1, -(-longest // 64))

    def run(batches):
        for b in batches:
            lists = b.column("embedding").cast(pa.list_(pa.float64()))
            values = lists.flatten().to_numpy(zero_copy_only=False) > 0
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.zeros((len(size), 8 * width), bool)
            bits[np.arange(8 * width) < size[:, None]] = values
            packed = np.packbits(bits, axis=1, bitorder="little")
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(size), [None, pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), flat.cast(pa.binary())], ["vec_id", "code"])

    return whole.mapInArrow(run, "vec_id long, code binary").groupBy("vec_id").agg(F.min("code").alias("code"))


def _blocks(table: DataFrame, n: int, *columns: str) -> DataFrame:
    """``n`` rows, each a part of ``table`` packed end to end, column by column."""

    def pack(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in columns])
            packed = [b"".join(t.column(c).to_pylist()) if pa.types.is_binary(t.schema.field(c).type) else t.column(c).to_numpy().tobytes() for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], list(columns))

    return table.select(*columns).repartition(n, columns[0]).mapInArrow(pack, ", ".join(f"{c} binary" for c in columns))


def nearest(vectors: DataFrame, k: int = K, queries: Column | str | None = None) -> DataFrame:
    """The k nearest codes of every vector that is a query: vec_id, rank (from 1), neighbor_id, distance.

    ``queries`` is a predicate over vec_id (all vectors by default); neighbours
    come from all vectors.  Ties go to the lesser id; fewer than k other vectors
    give fewer rows.  Rows with a null id or a null embedding are left out; a
    null or NaN component, or one that a shorter embedding lacks, counts as not
    above 0 (so does all of an empty embedding).  An id that occurs more than
    once is one vector, with the least of its codes as bytes.  An empty table
    gives none.  Other columns are not read.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    table = scratch.write(codes(vectors), "codes")
    asked = table.where(F.expr(queries) if isinstance(queries, str) else queries) if queries is not None else table
    least = W.partitionBy("code").orderBy("vec_id")
    index = scratch.write(table.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).select("vec_id", "code"), "index")
    distinct = scratch.write(asked.select("code").distinct(), "queries")
    n, m = index.count(), distinct.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, -(-n // INDEX_BLOCK))
    asks = max(1, -(-m // QUERY_BLOCK), min(4 * cores // parts, -(-m // 1024)))

    def search(batches):
        held, tables = None, None
        for b in batches:
            for qc, ii, ic in zip(*(b.column(c).to_pylist() for c in ("q", "vec_id", "code"))):
                ids = np.frombuffer(ii, np.int64)
                if held != ii:
                    held, tables = ii, Tables(np.frombuffer(ic, np.uint64).reshape(len(ids), -1), ids)
                q = np.frombuffer(qc, np.uint64).reshape(-1, tables.codes.shape[1])
                d, near = tables.search(q, k + 1)
                good = (d >= 0).ravel()
                width = 8 * q.shape[1]
                code = pa.array([qc[i : i + width] for i in range(0, len(qc), width)], pa.binary())
                yield pa.RecordBatch.from_arrays([code.take(pa.array(np.repeat(np.arange(len(q)), k + 1)[good])), near.ravel()[good], d.ravel()[good].astype(np.int32)], ["code", "neighbor_id", "distance"])

    left = _blocks(distinct, asks, "code").withColumnRenamed("code", "q")
    # few rows on both sides, each a block: the stated queries against all rows
    found = left.crossJoin(_blocks(index, parts, "vec_id", "code")).mapInArrow(search, "code binary, neighbor_id long, distance int")
    best = W.partitionBy("code").orderBy("distance", "neighbor_id")
    few = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = few.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))  # k + 1 at most
    own = asked.join(lists, "code").select("vec_id", F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("vec_id")), 1, k).alias("near"))
    out = own.select("vec_id", F.posexplode("near").alias("at", "x"))
    return out.select("vec_id", (F.col("at") + 1).alias("rank"), "x.neighbor_id", "x.distance")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """Ten nearest codes, among all embeddings, of every embedding whose id is a multiple of EVERY."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % EVERY == 0)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id,
    CAST(list_sum(list_transform(list_zip(a.bits, b.bits), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance FROM p)
SELECT vec_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""
