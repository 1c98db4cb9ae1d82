"""Algebra of sparse vectors in long form (key, token, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.weighting import unit


def dots(a: DataFrame, b: DataFrame, left: str = "a", right: str = "b", key: str = "doc_id") -> DataFrame:
    """(left, right, dot) of all pairs with a token in common."""
    x = a.select(F.col(key).alias(left), "token", F.col("w").alias("__x"))
    y = b.select(F.col(key).alias(right), "token", F.col("w").alias("__y"))
    return x.join(y, "token").groupBy(left, right).agg(F.sum(F.col("__x") * F.col("__y")).alias("dot"))


def norms(vec: DataFrame, key: str = "doc_id") -> DataFrame:
    return vec.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def angle_of(dot: Column) -> Column:
    """Angle of a cosine, clamped to [0, pi]."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def distances(a: DataFrame, b: DataFrame, kind: str = "normcosine", left: str = "a", right: str = "b", key: str = "doc_id") -> DataFrame:
    """(left, right, dist) of pairs with a token in common.

    "normcosine" and "normangle" expect unit vectors; "cosine" and "angle"
    divide by the norms.
    """
    if kind not in ("normcosine", "cosine", "normangle", "angle"):
        raise ValueError(f"unknown distance {kind!r}")
    d = dots(a, b, left, right, key)
    cos = F.col("dot")
    if kind in ("cosine", "angle"):
        d = d.join(norms(a, key).select(F.col(key).alias(left), F.col("norm").alias("__na")), left)
        d = d.join(norms(b, key).select(F.col(key).alias(right), F.col("norm").alias("__nb")), right)
        cos = F.col("dot") / (F.col("__na") * F.col("__nb"))
    return d.select(left, right, (angle_of(cos) if kind.endswith("angle") else 1 - cos).alias("dist"))


def add(a: DataFrame, b: DataFrame, key: str = "doc_id", sign: float = 1.0) -> DataFrame:
    """Sum of the vectors of equal keys, or with sign -1 their difference; zeros are dropped."""
    both = a.select(key, "token", "w").unionByName(b.select(key, "token", (F.col("w") * sign).alias("w")))
    return both.groupBy(key, "token").agg(F.sum("w").alias("w")).where("w <> 0")


def scale(vec: DataFrame, factor: float) -> DataFrame:
    return vec.withColumn("w", F.col("w") * factor)


def total(vec: DataFrame, cluster: str | None = None) -> DataFrame:
    """Sum of all vectors, or of those of each cluster: ([cluster,] token, w)."""
    keys = ([cluster] if cluster else []) + ["token"]
    return vec.groupBy(*keys).agg(F.sum("w").alias("w"))


def centroid(vec: DataFrame, cluster: str | None = None) -> DataFrame:
    """The total at unit length."""
    if cluster:
        return unit(total(vec, cluster), cluster)
    return unit(total(vec).withColumn("__one", F.lit(1)), "__one").drop("__one")


def to_maps(vec: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, vec map<token, w>)."""
    return vec.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "w")))).alias("vec"))


def from_maps(maps: DataFrame, key: str = "doc_id", column: str = "vec") -> DataFrame:
    return maps.select(key, F.explode(column).alias("token", "w"))


def coo(vec: DataFrame, ids: DataFrame, key: str = "doc_id", minweight: float = 1e-9) -> DataFrame:
    """(token_id, key, w) triplets; ids of 0 or less and small weights are dropped."""
    return vec.join(ids.select("token", "token_id"), "token").where((F.col("token_id") > 0) & (F.col("w") >= minweight)).select("token_id", key, "w")
