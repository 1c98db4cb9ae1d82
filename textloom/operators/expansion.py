"""Query expansion by synonyms (token, rank, neighbor, distance)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.vocabulary import Vocabulary
from textloom.operators.weighting import unit


def expand_vectors(vec: DataFrame, voc: Vocabulary, synonyms: DataFrame, use_distances: bool = False, weight: Callable[[Column, Column], Column] | None = None, normalize: bool = True, key: str = "doc_id") -> DataFrame:
    """Add to every vector the known neighbours of its own entries.

    A neighbour gets w / rank, or with ``use_distances`` w * exp(-distance)
    where a distance is known; ``weight(rank, distance)`` overrides both.
    Weights of one token add up; neighbours of neighbours are not followed.
    """
    rank, dist = F.col("rank"), F.col("distance")
    if weight is not None:
        f = weight(rank, dist)
    elif use_distances:
        f = F.coalesce(F.exp(-dist), 1 / rank)
    else:
        f = 1 / rank
    more = vec.join(synonyms.select("token", "rank", "neighbor", "distance"), "token").select(key, F.col("neighbor").alias("token"), (F.col("w") * f).alias("w"))
    more = more.join(voc.table.select("token"), "token", "left_semi")
    out = vec.select(key, "token", "w").unionByName(more.select(key, "token", "w")).groupBy(key, "token").agg(F.sum("w").alias("w"))
    return unit(out, key) if normalize else out


def expand_bags(bags: DataFrame, voc: Vocabulary, synonyms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add known neighbours with count 1 where the bag lacks them; counts that are there stay."""
    more = bags.join(synonyms.select("token", "neighbor"), "token").select(key, F.col("neighbor").alias("token")).distinct()
    more = more.join(voc.table.select("token"), "token", "left_semi").join(bags.select(key, "token"), [key, "token"], "left_anti")
    return bags.select(key, "token", "tf").unionByName(more.select(key, "token", F.lit(1).cast("long").alias("tf")))


def expand_tokens(tokens: DataFrame, synonyms: DataFrame, k: int = 0, key: str = "query_id") -> DataFrame:
    """(key, token) of the first ``k`` neighbours (0: all) of the tokens of each key, without its own tokens."""
    near = synonyms.where(F.col("rank") <= k) if k else synonyms
    more = tokens.join(near.select("token", "neighbor"), "token").select(key, F.col("neighbor").alias("token")).distinct()
    return more.join(tokens.select(key, "token").distinct(), [key, "token"], "left_anti")


def neighbours(synonyms: DataFrame, tokens: list[str], k: int = 0) -> list[str]:
    """The first ``k`` neighbours (0: all) of some tokens, without those tokens."""
    found = synonyms.where(F.col("token").isin(tokens))
    found = found.where(F.col("rank") <= k) if k else found
    # at most k rows a query token
    return [r["neighbor"] for r in found.select("neighbor").distinct().orderBy("neighbor").collect() if r["neighbor"] not in tokens]
