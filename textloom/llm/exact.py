"""Exact dedup through an extendible-hash index kept in the shared folder.

Keys are 64-bit hashes of the texts.  The key space is cut into equal ranges;
the owner task of a range keeps its own directory, doubles it whenever a bucket
of full local depth overflows, and writes its buckets as rows of a Parquet
dataset.  Equal keys are one entry of a bucket with the length of its chain and
the least id on it, counted before they are shuffled, so a text that very many
rows share is one entry.  Only texts on chains of two or more are then read
again, and they are compared byte by byte with the head of their chain; what
differs from the head forms the next chain.  ``lookup`` finds the chains of
further texts through a stored index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._shared import Scratch

BUCKET = 64
#: Keys of chained texts that are sent to all executors rather than shuffled to.
BROADCAST_KEYS = 2_000_000

INDEX_SCHEMA = "owner long, owner_bits int, global_depth int, local_depth int, prefix long, key long, n_bytes long, n long, head long"


class Directory:
    """Extendible hashing over the bits of a key below an owner's range.

    ``slots[p]`` is the bucket of the keys whose next ``depth`` bits are p.  A
    bucket over ``capacity`` distinct keys splits in two; if it already uses all
    ``depth`` bits the directory doubles first.  Equal keys share one entry (a
    chain), so copies never force a split.
    """

    def __init__(self, skip: int, capacity: int = BUCKET):
        self.skip, self.capacity, self.depth = skip, capacity, 0
        self.buckets: list[dict[int, list]] = [{}]
        self.local: list[int] = [0]
        self.slots: list[int] = [0]

    def slot(self, key: int) -> int:
        return (key << self.skip & (1 << 64) - 1) >> (64 - self.depth) if self.depth else 0

    def insert(self, key: int, value) -> None:
        """Put ``value`` on the chain of ``key`` (an unsigned 64-bit number)."""
        while True:
            at = self.slots[self.slot(key)]
            bucket = self.buckets[at]
            if key in bucket:
                bucket[key].append(value)
                return
            if len(bucket) < self.capacity or self.local[at] + self.skip >= 64:
                bucket[key] = [value]
                return
            self._split(at)

    def _split(self, at: int) -> None:
        if self.local[at] == self.depth:
            self.slots = [s for s in self.slots for _ in (0, 1)]
            self.depth += 1
        self.local[at] += 1
        other = len(self.buckets)
        self.local.append(self.local[at])
        bit = 64 - self.skip - self.local[at]
        old, self.buckets[at] = self.buckets[at], {}
        self.buckets.append({})
        for k, chain in old.items():
            self.buckets[other if k >> bit & 1 else at][k] = chain
        shift = self.depth - self.local[at]
        for p, s in enumerate(self.slots):
            if s == at and p >> shift & 1:
                self.slots[p] = other

    def find(self, key: int) -> list:
        """Chain of ``key``, empty if there is none: one slot, one bucket."""
        return self.buckets[self.slots[self.slot(key)]].get(key, [])

    @classmethod
    def of(cls, skip: int, depth: int, entries) -> Directory:
        """The directory of stored (local depth, prefix, key, value)."""
        d = cls(skip)
        d.depth, d.buckets, d.local, d.slots = depth, [], [], [-1] * (1 << depth)
        at: dict[tuple[int, int], int] = {}
        for local, prefix, key, value in entries:
            b = at.get((local, prefix))
            if b is None:
                b = at[local, prefix] = len(d.buckets)
                d.buckets.append({})
                d.local.append(local)
                lo = prefix << (depth - local)
                d.slots[lo : lo + (1 << depth - local)] = [b] * (1 << depth - local)
            d.buckets[b][key] = [value]
        d.buckets.append({})  # for slots of buckets that hold nothing
        d.local.append(depth)
        d.slots = [s if s >= 0 else len(d.buckets) - 1 for s in d.slots]
        return d

    def rows(self):
        """(local depth, prefix, key, chain) of every entry."""
        first = {}
        for p, s in enumerate(self.slots):
            first.setdefault(s, p)
        for at, bucket in enumerate(self.buckets):
            prefix = first[at] >> (self.depth - self.local[at])
            for k, chain in bucket.items():
                yield self.local[at], prefix, k, chain


def build_index(docs: DataFrame, keys_per_owner: int = 1 << 16) -> DataFrame:
    """Index rows (INDEX_SCHEMA) of all non-null texts of ``docs`` (doc_id, text) that have an id: one a distinct key."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    n = docs.count()
    bits = max(4, int(np.ceil(np.log2(max(1, n) / keys_per_owner))) if n else 4)
    keys = rows.select("doc_id", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))
    entries = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n"), F.min("n_bytes").alias("n_bytes"))
    entries = entries.withColumn("owner", F.shiftrightunsigned("key", 64 - bits))

    def own(batch: pa.Table) -> pa.Table:
        owner = batch.column("owner")[0].as_py()
        # the order of arrival differs from run to run; this one doesn't
        batch = batch.sort_by("key")
        d = Directory(bits)
        key = batch.column("key").to_numpy().view(np.uint64).tolist()
        for k, value in zip(key, zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "n", "head")))):
            d.insert(k, value)
        rows = [(lo, p, k, *chain[0]) for lo, p, k, chain in d.rows()]
        local, prefix, ks, size, n, head = zip(*rows)
        m = len(rows)
        return pa.table({
            "owner": pa.array([owner] * m, pa.int64()), "owner_bits": pa.array([bits] * m, pa.int32()), "global_depth": pa.array([d.depth] * m, pa.int32()), "local_depth": pa.array(local, pa.int32()),
            "prefix": pa.array(prefix, pa.int64()), "key": pa.array(np.array(ks, np.uint64).view(np.int64)), "n_bytes": pa.array(size, pa.int64()), "n": pa.array(n, pa.int64()), "head": pa.array(head, pa.int64()),
        })

    return entries.groupBy("owner").applyInArrow(own, INDEX_SCHEMA)


def lookup(index: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, key, head, n) of the texts of ``docs`` whose key a stored index holds.

    Owner tasks read the buckets of their key range and probe slot and bucket
    for every key that falls into it; keys are looked up once each.  Equal keys
    are candidates: bytes remain to be compared.  Rows with a null id or text
    are not looked up.
    """
    first = index.select("owner_bits").first()
    bits = first["owner_bits"] if first else 4
    keys = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("key"))
    asked = keys.select("key").distinct().withColumn("owner", F.shiftrightunsigned("key", 64 - bits))

    def probe(own: pa.Table, ask: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and ask.num_rows:
            at = own.column("key").to_numpy().view(np.uint64).tolist()
            values = zip(own.column("head").to_pylist(), own.column("n").to_pylist())
            d = Directory.of(bits, own.column("global_depth")[0].as_py(), zip(own.column("local_depth").to_pylist(), own.column("prefix").to_pylist(), at, values))
            key = ask.column("key").to_numpy()
            found = [(k, *v) for k, u in zip(key.tolist(), key.view(np.uint64).tolist()) for v in d.find(u)]
        cols = list(zip(*found)) if found else [()] * 3
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("key", "head", "n"), cols)})

    met = index.groupBy("owner").cogroup(asked.groupBy("owner")).applyInArrow(probe, "key long, head long, n long")
    return keys.join(met, "key").select("doc_id", "key", "head", "n")


def _chained(docs: DataFrame, scratch: Scratch, broadcast_keys: int) -> DataFrame:
    """(doc_id, key, keep_id) of every row on a chain of two or more, after comparing bytes; keep_id heads its group."""
    index = scratch.write(build_index(docs), "index")
    chains = scratch.write(index.where("n > 1").select("key", "head"), "chains")
    few = chains.count() <= broadcast_keys  # 16 bytes each
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("key"))
    members = texts.join(F.broadcast(chains) if few else chains, "key")
    settled, step = [], 0
    while True:
        # a head's own repeated rows are one text each; the least text stands for an id that has several
        heads = members.where(F.col("doc_id") == F.col("head")).groupBy("key").agg(F.min("text").alias("of"))
        compared = members.join(heads, "key").withColumn("same", F.col("text") == F.col("of"))
        done = scratch.write(compared.select("doc_id", "key", "head", "same", F.when(~F.col("same"), F.col("text")).alias("text")), f"compared{step}")
        settled.append(done.where("same").select("doc_id", "key", F.col("head").alias("keep_id"), F.lit(step).alias("step")))
        rest = done.where("not same")
        if rest.isEmpty():  # always, short of two texts with one 64-bit hash
            break
        heads_next = rest.groupBy("key").agg(F.min("doc_id").alias("head"))
        members = rest.drop("head", "same").join(heads_next, "key")
        step += 1
    scratch.drop("chains")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def duplicates(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Surplus copies: doc_id, keep_id, surplus_rows.

    One row per id and group of byte-identical texts in which rows of that id
    are surplus; ``keep_id`` is the least id of the group, ``surplus_rows`` the
    number of rows to drop.  An id repeated with the same text is its own
    keep_id with one row fewer.  Rows with a null id or a null text are never
    compared and never surplus; empty texts are texts and equal each other.
    Columns other than doc_id and text are not read.  An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    groups = _chained(docs.select("doc_id", "text"), scratch, broadcast_keys).groupBy("doc_id", "key", "step", "keep_id").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("doc_id") == F.col("keep_id"), 1).otherwise(0)
    return groups.select("doc_id", "keep_id", (F.col("n") - own).alias("surplus_rows")).where("surplus_rows > 0")


def drop_duplicates(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with one row of each group of byte-identical texts, all columns kept.

    The row of the least id stays (of that id's identical texts one row, the
    first by its other columns).  Rows with a null id or text all stay, empty
    texts equal each other, texts are compared whole, however long, and an
    empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    cols = docs.columns
    chained = _chained(docs.select("doc_id", "text"), scratch, broadcast_keys)
    flagged = chained.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.max(F.when(F.col("doc_id") == F.col("keep_id"), 1).otherwise(0)).alias("__head"), F.count(F.lit(1)).alias("__n")
    )
    flagged = scratch.write(flagged.where("__head = 0 or __n > 1"), "flagged")
    small = flagged.count() <= broadcast_keys
    marks = F.broadcast(flagged) if small else flagged
    # whole rows travel in one column: no name of theirs can clash
    packed = docs.select(F.col("doc_id").alias("__at"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("__k"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"))
    marked = packed.join(marks, (F.col("__at") == F.col("__id")) & (F.col("__k") == F.col("__key")), "left")
    plain = marked.where(F.col("__id").isNull()).select("__row.*")
    if flagged.where("__head = 1").isEmpty():
        return plain
    # an id given several times with one text: few rows, and only they are shuffled
    repeated = marked.where(F.col("__head") == 1).groupBy("__at", F.col("__row.text").alias("__text")).agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return plain.unionByName(repeated.select("__row.*"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Surplus copies among all documents."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT doc_id, keep_id, count(*) AS n FROM d GROUP BY doc_id, keep_id)
SELECT doc_id, keep_id, n - CASE WHEN doc_id = keep_id THEN 1 ELSE 0 END AS surplus_rows
FROM g WHERE n - CASE WHEN doc_id = keep_id THEN 1 ELSE 0 END > 0
"""
