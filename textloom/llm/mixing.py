"""Mixing sources to time-varying target weights.

Source s has a weight w_s(t) over training time t in [0, 1], linear between
knots, with the weights of all sources summing to 1 at any time.  Its demand up
to t is T times the integral of w_s; a document that begins after c tokens of
its source is trained at the time where that demand reaches c, which has a
closed form on each linear piece.  Documents are then range-sorted by time.

T is the largest total that gives every source its integral of the weight
without using it more than ``max_epochs`` times; documents past it are left
out, so the scarcest source bounds what is used of all others.  With ``whole``
each source has a total of its own, supply over integral: every document of a
source with weight is placed once, and sources keep the course of their weights
over time but not its height, as no order of all documents can keep both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm._shared import Scratch

#: (t, exponent): at t, sources weigh as their share of tokens to this power.
CURRICULUM = ((0.0, 1.0), (1.0, 0.5))
WORD = "[^ \\t\\r\\n]+"
#: Hex digits of the hash that cut a source into ranges for its running sum.
DIGITS = 3


def _supply(each: DataFrame) -> DataFrame:
    """Tokens by source and hash range, with the sum of the ranges before it and of the source."""
    sums = each.groupBy("__src", "__cut").agg(F.sum("__tok").alias("__sum"))
    by = W.partitionBy("__src")
    return sums.select("__src", "__cut", (F.sum("__sum").over(by.orderBy("__cut")) - F.col("__sum")).alias("__base"), F.sum("__sum").over(by).alias("__supply"))


def _pieces(supply: DataFrame, curriculum, schedule) -> DataFrame:
    """One row per source: its supply, total demand and linear pieces."""
    spark = supply.sparkSession
    one = supply.groupBy("__src").agg(F.first("__supply").cast("double").alias("__supply"))
    if schedule is None:
        share = one.withColumn("__p", F.col("__supply") / F.sum("__supply").over(W.partitionBy()))
        knots = share.select("__src", "__supply", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.pow("__p", F.lit(float(x))).alias("w")) for t, x in curriculum])).alias("k"))
    else:
        rows = [(s, float(t), float(w)) for s, ks in schedule.items() for t, w in ks]
        given = spark.createDataFrame(rows, "__src string, t double, w double")
        knots = one.join(given, "__src").select("__src", "__supply", F.struct("t", "w").alias("k"))
    knots = knots.select("__src", "__supply", "k.t", (F.col("k.w") / F.sum("k.w").over(W.partitionBy("k.t"))).alias("w"))
    follow = W.partitionBy("__src").orderBy("t")
    seg = knots.select("__src", "__supply", F.col("t").alias("t0"), F.col("w").alias("w0"), F.lead("t").over(follow).alias("t1"), F.lead("w").over(follow).alias("w1")).where("t1 is not null")
    seg = seg.withColumn("area", (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2)
    seg = seg.withColumn("a1", F.sum("area").over(W.partitionBy("__src").orderBy("t0")))
    seg = seg.withColumn("a0", F.col("a1") - F.col("area")).withColumn("slope", (F.col("w1") - F.col("w0")) / (F.col("t1") - F.col("t0")))
    out = seg.groupBy("__src").agg(F.first("__supply").alias("__own"), F.sum("area").alias("__all"), F.sort_array(F.collect_list(F.struct("a0", "a1", "t0", "w0", "slope"))).alias("__seg"))
    return out


def _time(u: Column, seg: Column) -> Column:
    """Time at which the integral of a weight reaches ``u``."""
    s = F.element_at(F.filter(seg, lambda s: (s["a0"] <= u) & (u < s["a1"])), 1)
    c = u - s["a0"]
    return s["t0"] + F.when(c <= 0, 0.0).otherwise(2 * c / (s["w0"] + F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * s["slope"] * c, F.lit(0.0)))))


def tokens_of(text: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0))


def positions(docs: DataFrame, curriculum=CURRICULUM, schedule: dict | None = None, max_epochs: int = 1, whole: bool = False, tokens: str | None = None) -> DataFrame:
    """(doc_id, source, row, tokens, epoch, time) without what the budget leaves out; ``whole`` leaves out none.

    ``docs`` needs doc_id, source and text, or the name of an integer column
    with the number of tokens in ``tokens`` (null counts as 0); ``row`` is the
    input row as a struct, whatever its columns are called.  ``schedule`` maps
    a source to its (t, weight) knots, the same times for all; sources it
    doesn't name, or whose weights are all 0, are left out.  A null source
    counts as the source ''.  Null, empty and blank texts hold no tokens and
    take no position; a text is counted whole, however long.  Within a source
    documents come in the order of the MD5 of their id (null ids first), then
    id, then size; repeated rows follow each other.  An empty table gives an
    empty result.  ``max_epochs`` of 1 or more repeats a source up to as often.
    """
    if max_epochs < 1:
        raise ValueError("max_epochs must be at least 1")
    if whole and max_epochs != 1:
        raise ValueError("whole places every document once")
    # whole rows travel in one column: none of their names can clash with the ones used here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    count = tokens_of() if tokens is None else F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0))
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("__src"), count.alias("__tok"), row)
    each = own.where("__tok > 0").withColumn("__ord", F.coalesce(F.md5(F.col("id").cast("string")), F.lit(""))).withColumn("__cut", F.substring("__ord", 1, DIGITS))
    supply = _supply(each)
    pieces = _pieces(supply, curriculum, schedule)
    if whole:
        placed = pieces.where("__all > 0").withColumn("__total", F.col("__own") / F.col("__all"))
        plan = supply.join(placed, "__src")
    else:
        total = pieces.where("__all > 0").agg((F.min(F.col("__own") / F.col("__all")) * max_epochs).alias("__total"))
        plan = supply.join(pieces, "__src").crossJoin(F.broadcast(total))  # one row is broadcast
    # a row per source and range joins the documents on the key they are already partitioned by
    plan = plan.select("__src", "__cut", "__base", "__own", "__all", "__seg", "__total")
    running = W.partitionBy("__src", "__cut").orderBy("__ord", "id", "__tok").rowsBetween(W.unboundedPreceding, 0)
    before = each.withColumn("__before", F.sum("__tok").over(running) - F.col("__tok"))
    at = before.join(plan, ["__src", "__cut"])
    at = at.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))) if max_epochs > 1 else F.lit(0))
    at = at.withColumn("__u", (F.col("__base") + F.col("__before") + F.col("__epoch") * F.col("__own")) / F.col("__total"))
    at = at.where(F.col("__u") < F.element_at(F.col("__seg"), -1)["a1"])
    at = at.withColumn("__time", F.round(_time(F.col("__u"), F.col("__seg")), 9))
    return at.select(F.col("id").alias("doc_id"), F.col("__src").alias("source"), "row", F.col("__tok").alias("tokens"), F.col("__epoch").alias("epoch"), F.col("__time").alias("time"))


def counted(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A stored table of doc_id, source and tokens: each text is read and counted once."""
    return scratch.write(docs.select("doc_id", "source", tokens_of().cast("long").alias("tokens")), "counted")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The chosen rows of ``docs`` in training order, with its columns, whatever they are called (see ``positions``).

    Rows of one time follow their ids, then their epochs.  Written as files,
    the rows keep this order from file to file and within each.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    # the count goes along with the row, so that only this pass reads words out of texts
    packed = docs.select("doc_id", "source", tokens_of().alias("tokens"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    stored = scratch.write(packed, "counted")
    return positions(stored, tokens="tokens", **how).orderBy("time", "doc_id", "epoch").select("row.own.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Training order of all documents: doc_id, source, tokens, epoch, time."""
    docs = counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "mixing"))
    out = positions(docs, tokens="tokens")
    return out.select("doc_id", "source", F.col("tokens").cast("long"), "epoch", "time").orderBy("time", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) AS BIGINT) AS tokens,
    coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS ord FROM documents),
e AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY ord, doc_id NULLS FIRST, tokens ROWS UNBOUNDED PRECEDING) - tokens AS c FROM d WHERE tokens > 0),
s AS (SELECT source, CAST(sum(tokens) AS DOUBLE) AS own FROM d WHERE tokens > 0 GROUP BY source),
p AS (SELECT source, own, own / sum(own) OVER () AS p FROM s),
w AS (SELECT source, own, p / sum(p) OVER () AS w0, sqrt(p) / sum(sqrt(p)) OVER () AS w1 FROM p),
t AS (SELECT min(own / ((w0 + w1) / 2)) AS total FROM w),
u AS (SELECT e.doc_id, e.source, e.tokens, e.c / t.total AS u, w0, w1 FROM e JOIN w USING (source) CROSS JOIN t)
SELECT doc_id, source, tokens, 0 AS epoch,
    round(CASE WHEN u <= 0 THEN 0.0 ELSE 2 * u / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * u, 0.0))) END, 9) AS time
FROM u WHERE u < (w0 + w1) / 2
"""
