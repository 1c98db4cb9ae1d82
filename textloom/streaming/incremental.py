"""Streams of documents folded into stored tables, batch by batch.

Each micro-batch is written under its own batch id, so a batch that is run
again after a failure replaces itself; the current state is the sum of what
has been written.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import TextConfig
from textloom.operators import vocabulary as vb
from textloom.operators.index import BM25Index
from textloom.operators.vocabulary import Vocabulary


def vocabulary_sink(root: str, cfg: TextConfig, text: str = "text"):
    """foreachBatch function that stores each batch's counters and statistics under ``root``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        voc = vb.vocabulary(batch, cfg, text)
        voc.table.write.mode("overwrite").parquet(f"{root}/vocab/batch={batch_id}")
        voc.stats.write.mode("overwrite").parquet(f"{root}/stats/batch={batch_id}")

    return write


def read_vocabulary(spark: SparkSession, root: str, cfg: TextConfig) -> Vocabulary:
    """Vocabulary of all batches stored so far."""
    table = spark.read.parquet(f"{root}/vocab").groupBy("token").agg(F.sum("occs").alias("occs"), F.sum("ndocs").alias("ndocs"))
    stats = spark.read.parquet(f"{root}/stats").agg(F.sum("trainsize").alias("trainsize"), F.sum("numtokens").alias("numtokens"))
    return Vocabulary(table, stats, cfg)


def _part(token: str, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def index_sink(root: str, cfg: TextConfig, text: str = "text", buckets: int = 64):
    """foreachBatch function that appends bags partitioned by a hash of the token, so a search can read its tokens' parts only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        bags = vb.terms(batch, cfg, text).bags.select("doc_id", "token", "tf", "doclen").withColumn("part", _part("token", buckets))
        bags.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/batch={batch_id}")

    return write


def read_index(spark: SparkSession, root: str, voc: Vocabulary, tokens: DataFrame | None = None, buckets: int = 64, **how) -> BM25Index:
    """Index over all batches stored so far; given the ``tokens`` of some queries, only the parts that hold them are read.

    Postings carry the length of their document, counted before they were cut
    into parts, so scores don't depend on what is read.
    """
    stored = spark.read.parquet(root)
    if tokens is not None:
        # the number of parts bounds this
        parts = [r["part"] for r in tokens.select(_part("token", buckets).alias("part")).distinct().collect()]
        stored = stored.where(F.col("part").isin(parts))
    index = BM25Index(voc, **how)
    own = vb.keep_known(stored, voc).select("doc_id", "token", "tf", "doclen")
    return replace(index, postings=own)


def start(stream: DataFrame, sink, checkpoint: str, once: bool = False):
    """Run a sink over a stream."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
