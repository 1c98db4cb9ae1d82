"""Term weighting and sparse vectors (doc_id, token, w)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.vocabulary import Terms, Vocabulary, bag_of_words

LOCAL = ("tf", "freq", "tp", "binary")
GLOBAL = ("idf", "binary", "entropy")
MINWEIGHT = 1e-6


@dataclass(frozen=True)
class VectorModel:
    """A vocabulary with a weight a token: ``weights`` (token, occs, ndocs, weight)."""

    voc: Vocabulary
    weights: DataFrame
    global_weighting: str
    local_weighting: str
    #: All tokens weigh 1.
    constant: bool = False

    @property
    def maxoccs(self) -> int:
        return self.voc.table.agg(F.max("occs")).first()[0]

    def get(self, token: str) -> dict:
        r = self.weights.where(F.col("token") == token).first()
        return r.asDict() if r else {"token": "", "occs": 0, "ndocs": 0, "weight": 0.0}

    def filter(self, predicate: Column | str) -> VectorModel:
        """Tokens that satisfy a predicate over token, occs, ndocs, weight."""
        return replace(self, voc=replace(self.voc, terms=None), weights=self.weights.where(predicate))


def vector_model(voc: Vocabulary, global_weighting: str = "idf", local_weighting: str = "tf", weights: DataFrame | None = None) -> VectorModel:
    """Weights of a vocabulary, computed or given as (token, weight)."""
    if local_weighting not in LOCAL or global_weighting not in GLOBAL:
        raise ValueError(f"unknown weighting {global_weighting}/{local_weighting}")
    if voc.terms is None and voc.table.isEmpty() or voc.terms is not None and voc.terms.rows.isEmpty():
        raise ValueError("the vocabulary is empty")
    if weights is not None:
        table = voc.table.join(weights, "token")
    elif global_weighting == "entropy":
        raise ValueError("entropy weights need labels: use entropy_model")
    else:
        w = F.log2((0.5 + F.col("trainsize")) / (0.5 + F.col("ndocs"))) if global_weighting == "idf" else F.lit(1.0)
        table = voc.with_stats().withColumn("weight", w).drop("trainsize", "numtokens")
    return VectorModel(voc, table, global_weighting, local_weighting, weights is None and global_weighting == "binary")


def _combine(name: str, h: Column, hmax: Column, ndocs: Column) -> Column:
    ratio = 1 - h / hmax
    if name == "normalized":
        return ratio
    if name == "penalize":
        return (hmax - h) * F.log2(ndocs)
    if name == "sigmoid":
        return ratio * (1 - 1 / (1 + F.log2(ndocs)))
    raise ValueError(f"unknown combination {name!r}")


def entropy_weights(voc: Vocabulary, docs: DataFrame, label: str, mindocs: int = 3, smooth: float = 3.0, weights="balance", comb: str = "normalized", text: str = "text") -> DataFrame:
    """(token, weight): how unevenly a token's documents spread over classes.

    Counts are documents of the class holding the token, plus ``smooth``.
    ``weights`` multiplies classes: "balance" (total over class total), "none"
    or None, or a map from class to weight.  Tokens of fewer than ``mindocs``
    documents weigh 0.
    """
    own = docs.where(F.col(label).isNotNull())
    bags = bag_of_words(voc, own, text).join(own.select("doc_id", F.col(label).alias("__class")), "doc_id")
    return entropy_of_counts(voc, bags.groupBy("token", "__class").agg(F.count(F.lit(1)).alias("__n")), own.select(F.col(label).alias("__class")).distinct(), mindocs, smooth, weights, comb)


def entropy_of_counts(voc: Vocabulary, seen: DataFrame, classes: DataFrame, mindocs: int = 3, smooth: float = 3.0, weights="balance", comb: str = "normalized") -> DataFrame:
    """The same from (token, __class, __n) with the documents of each class that hold a token.

    A class in which a token doesn't occur adds the same to every token, so
    only the counts that are there are touched, never tokens times classes.
    """
    smooth = float(smooth)
    f = lambda d: F.when(d > 0, d * F.log2(d)).otherwise(0.0)
    if weights == "balance":
        size = voc.table.agg((F.count(F.lit(1)) * smooth).alias("__base"))
        rows = classes.join(seen.groupBy("__class").agg(F.sum("__n").alias("__sum")), "__class", "left").crossJoin(size)  # one row
        rows = rows.select("__class", (F.coalesce("__sum", F.lit(0)) + F.col("__base")).alias("__row"))
        scale = rows.withColumn("__cw", F.sum("__row").over(W.partitionBy()) / F.col("__row")).select("__class", "__cw")
    elif isinstance(weights, dict):
        given = classes.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], f"__class {dict(classes.dtypes)['__class']}, __cw double")
        scale = classes.join(given, "__class")
    elif weights in (None, "none"):
        scale = classes.withColumn("__cw", F.lit(1.0))
    else:
        raise ValueError(f"unknown class weights {weights!r}")
    empty = F.col("__cw") * smooth
    whole = scale.agg(F.coalesce(F.sum(empty), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum(f(empty)), F.lit(0.0)).alias("__e0"), F.log2(F.count(F.lit(1)).cast("double")).alias("hmax"))
    d = F.col("__cw") * (F.col("__n") + smooth)
    per = seen.join(scale, "__class").groupBy("token").agg(F.sum(d - empty).alias("__s"), F.sum(f(d) - f(empty)).alias("__e"))
    every = voc.table.select("token", "ndocs").join(per, "token", "left").crossJoin(F.broadcast(whole))  # one row
    s, e = F.col("__s0") + F.coalesce("__s", F.lit(0.0)), F.col("__e0") + F.coalesce("__e", F.lit(0.0))
    h = F.when(s > 0, F.log2(s) - e / s).otherwise(0.0)
    weight = F.when(F.col("ndocs") < mindocs, 0.0).otherwise(_combine(comb, h, F.col("hmax"), F.col("ndocs")))
    return every.select("token", weight.alias("weight"))


def entropy_model(voc: Vocabulary, docs: DataFrame, label: str, local_weighting: str = "tf", **how) -> VectorModel:
    return vector_model(voc, "entropy", local_weighting, entropy_weights(voc, docs, label, **how))


def vectorize_bags(model: VectorModel, bags: DataFrame, normalize: bool = True, minweight: float = MINWEIGHT, key: str = "doc_id") -> DataFrame:
    """(key, token, w) of bags (key, token, tf): local times global weight, small ones dropped, unit length."""
    doc = W.partitionBy(key)
    joined = bags.join(model.weights.select("token", "weight"), "token")
    local = {
        "tf": F.col("tf") / F.max("tf").over(doc),
        "freq": F.col("tf").cast("double"),
        "tp": F.col("tf") / F.sum("tf").over(doc),
        "binary": F.lit(1.0),
    }[model.local_weighting]
    vec = joined.withColumn("w", local * F.col("weight")).where(F.col("w") >= minweight).select(key, "token", "w")
    return unit(vec, key) if normalize else vec


def vectorize_terms(model: VectorModel, terms: Terms, normalize: bool = True, minweight: float = MINWEIGHT) -> DataFrame:
    """Sparse vectors of stored terms; those of the model's own documents need no look at what a document holds."""
    if model.voc.terms is not terms:
        return vectorize_bags(model, terms.bags.select("doc_id", "token", "tf"), normalize, minweight)
    if model.constant and terms.unique:
        return _row_vectors(model, terms, normalize, minweight)
    local = {"tf": F.col("tf") / (F.col("maxtf") if terms.unique else F.max("tf").over(W.partitionBy("doc_id"))), "freq": F.col("tf").cast("double"), "tp": F.col("tf") / F.col("doclen"), "binary": F.lit(1.0)}[model.local_weighting]
    vec = terms.bags.join(model.weights.select("token", "weight"), "token").withColumn("w", local * F.col("weight")).where(F.col("w") >= minweight).select("doc_id", "token", "w")
    return unit(vec) if normalize else vec


def _row_vectors(model: VectorModel, terms: Terms, normalize: bool, minweight: float) -> DataFrame:
    """Vectors under weights of 1, each made within its document's row."""
    local = {"tf": lambda x: x["tf"] / F.col("maxtf"), "freq": lambda x: x["tf"].cast("double"), "tp": lambda x: x["tf"] / F.col("doclen"), "binary": lambda x: F.lit(1.0)}[model.local_weighting]
    vec = terms.rows.select("doc_id", F.filter(F.transform("terms", lambda x: F.struct(x["token"].alias("token"), local(x).alias("w"))), lambda x: x["w"] >= minweight).alias("__v"))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])) if normalize else F.lit(1.0)
    # in a step of its own: beside the explode it would be taken again for each token
    return vec.select("doc_id", norm.alias("__n"), "__v").select("doc_id", "__n", F.explode("__v").alias("__x")).select("doc_id", "__x.token", (F.col("__x.w") / F.col("__n")).alias("w"))


def vectorize(model: VectorModel, docs: DataFrame, text: str = "text", normalize: bool = True, minweight: float = MINWEIGHT, **how) -> DataFrame:
    """Sparse vectors of documents."""
    return vectorize_bags(model, bag_of_words(model.voc, docs, text, **how), normalize, minweight)


def unit(vec: DataFrame, key: str = "doc_id") -> DataFrame:
    """Vectors scaled to unit length."""
    return vec.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key))))
