"""Documents to token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.config import TextConfig
from textloom.functions import tokenize as tk
from textloom.functions.normalize import normalize_col
from textloom.functions.transforms import LITERAL_LEMMAS, IgnoreStopwords, LemmaTransformation, steps
from textloom.scratch import Scratch

#: Stopwords kept in the plan as literals; larger sets are joined.
LITERAL_STOPWORDS = 10_000


#: Inputs up to this many bytes a core are spread over all cores before they are tokenized, but not very small ones.
SPREAD_BYTES = 32 << 20
_SPREAD_FROM = 1 << 18


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores: files of one row group would else keep one core busy.

    The size is the optimizer's estimate, so nothing runs; large inputs have
    many splits of their own and are left as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if _SPREAD_FROM < size < cores * SPREAD_BYTES else df


def _is_array(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column].startswith("array")


def _once(column: Column) -> Column:
    """``column`` behind an expression that filters aren't pushed through: they would repeat the tokenization."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def _joined(df: DataFrame, step) -> DataFrame:
    """Apply a large stopword set or lemma map to __uni by a join, keeping the order of tokens."""
    spark = df.sparkSession
    # numbered and stored once: rows and their tokens must meet again under the same numbers
    rows = Scratch(spark, "tokens").write(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    long = rows.select("__row", F.posexplode("__uni").alias("__pos", "__t"))
    if isinstance(step, IgnoreStopwords):
        out = spark.createDataFrame([(t,) for t in sorted(step.stopwords)], "__t string")
        long = long.join(out, "__t", "left_anti")
    else:
        table = spark.createDataFrame(list(step.lemmas), "__t string, __lemma string")
        long = long.join(table, "__t", "left").select("__row", "__pos", F.coalesce("__lemma", "__t").alias("__t"))
    again = long.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.struct("__pos", "__t"))), lambda s: s["__t"]).alias("__new"))
    return rows.join(again, "__row", "left").withColumn("__uni", F.coalesce("__new", F.array().cast("array<string>"))).drop("__row", "__new")


def tokenize(docs: DataFrame, cfg: TextConfig, text: str = "text", out: str = "tokens", isnormalized: bool = False, pretokenized: bool = False) -> DataFrame:
    """``docs`` with the array column ``out``.

    ``text`` may be a string, an array of strings (the fields of one document:
    no n-gram crosses a field) or, with ``pretokenized``, an array of tokens
    that is taken as it is.  A null text has null tokens.
    """
    if pretokenized:
        return docs.withColumn(out, F.col(text))
    docs = spread(docs)
    big = [s for s in steps(cfg.transformation) if isinstance(s, IgnoreStopwords) and len(s.stopwords) > LITERAL_STOPWORDS or isinstance(s, LemmaTransformation) and len(s.lemmas) > LITERAL_LEMMAS]
    if _is_array(docs, text):
        if not big:
            return docs.withColumn(out, tk.field_tokens_col(cfg, text, isnormalized))
        row = Scratch(docs.sparkSession, "tokens").write(docs.withColumn("__doc", F.monotonically_increasing_id()), "rows")
        fields = row.select("__doc", F.posexplode_outer(text).alias("__field", "__text"))
        each = tokenize(fields, cfg, "__text", "__tokens", isnormalized)
        again = each.groupBy("__doc").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__field", "__tokens"))), lambda s: s["__tokens"])).alias(out))
        return row.join(again, "__doc").drop("__doc")
    df = docs.withColumn("__norm", normalize_col(cfg.normalization, text, isnormalized)).withColumn("__uni", _once(tk.split_tokens("__norm")))
    for s in steps(cfg.transformation):
        df = _joined(df, s) if s in big else df.withColumn("__uni", s.apply(F.col("__uni")))
    return df.withColumn(out, tk.assemble(cfg, F.col("__uni"), F.col("__norm"))).drop("__norm", "__uni")


def count_in_row(tokens: str) -> Column:
    """Array of (token, tf) of an array of tokens that is sorted.

    Counting happens inside the row: no shuffle brings a document's tokens
    together again.
    """
    t = F.col(tokens)
    begins = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())
    after = F.concat(F.slice(begins, 2, F.greatest(F.size(begins), F.lit(1))), F.array(F.size(t)))
    return F.zip_with(begins, after, lambda a, b: F.struct(F.get(t, a).alias("token"), (b - a).cast("long").alias("tf")))


def term_frequencies(tokens: DataFrame, column: str = "tokens", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, token, tf) of every distinct token of every row; null and empty arrays have none."""
    ordered = tokens.where(F.size(column) > 0).select(*keys, F.sort_array(column).alias("__sorted"))
    counted = ordered.select(*keys, F.explode(count_in_row("__sorted")).alias("__c"))
    return counted.select(*keys, "__c.token", "__c.tf")


def batches(docs: DataFrame, size: int, order: str = "doc_id") -> DataFrame:
    """``docs`` with batch_id, ``size`` rows each in the given order; 0 or less is one batch."""
    if size <= 0:
        return docs.withColumn("batch_id", F.lit(0).cast("long"))
    # stored in order once, so that rows and the counts of their partitions come from one sort
    rows = docs.select(F.col(order).alias("__by"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).orderBy("__by")
    placed = rows.select("__row", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    stored = Scratch(docs.sparkSession, "batches").write(placed, "sorted")
    counts = {r["__part"]: r["count"] for r in stored.groupBy("__part").count().collect()}  # one row a partition
    before, start = {}, 0
    for part in sorted(counts):
        before[part] = start
        start += counts[part]
    if not before:
        return docs.withColumn("batch_id", F.lit(0).cast("long"))
    first = docs.sparkSession.createDataFrame(list(before.items()), "__part int, __first long")
    return stored.join(F.broadcast(first), "__part").select("__row.*", F.floor((F.col("__first") + F.col("__at")) / size).alias("batch_id"))
