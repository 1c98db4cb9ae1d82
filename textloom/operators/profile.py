"""Text profiles: a weighted vocabulary with stopwords, lemmas, synonyms and their history."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.config import TextConfig
from textloom.functions.transforms import ChainTransformation, IgnoreStopwords, LemmaTransformation
from textloom.operators import vocabulary as vb
from textloom.operators.lemmas import extend_lemmas
from textloom.operators.vocabulary import Vocabulary
from textloom.operators.weighting import VectorModel, vector_model

SYNONYMS = "token string, rank int, neighbor string, distance double"
LEMMAS = "token string, lemma string"


@dataclass(frozen=True)
class Applied:
    """Which artifacts the profile's config uses."""

    stopwords: bool = False
    lemmas: bool = False
    synonyms: bool = False


@dataclass(frozen=True)
class Step:
    """One entry of a profile's history."""

    kind: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Profile:
    """A model and its artifacts; the config follows from the policy, the artifacts and the applied flags."""

    model: VectorModel
    stopwords: frozenset[str] = frozenset()
    lemmas: dict[str, str] = field(default_factory=dict)
    synonyms: DataFrame | None = None
    applied: Applied = Applied()
    lineage: tuple[Step, ...] = (Step("fit"),)

    @property
    def policy(self) -> TextConfig:
        return self.model.voc.cfg.replace(transformation=None)

    @property
    def cfg(self) -> TextConfig:
        return materialize(self.policy, self.lemmas if self.applied.lemmas else {}, self.stopwords if self.applied.stopwords else ())

    def with_applied(self, **flags: bool) -> Profile:
        return replace(self, applied=replace(self.applied, **flags))

    @property
    def isbase(self) -> bool:
        return self.lineage[-1].kind != "refit"

    @property
    def istuned(self) -> bool:
        return not self.isbase

    def lineage_summary(self) -> str:
        return " -> ".join(s.kind for s in self.lineage)


def materialize(policy: TextConfig, lemmas: dict, stopwords) -> TextConfig:
    """Lemmas before stopwords; empty artifacts leave no step."""
    parts = ([LemmaTransformation(lemmas)] if lemmas else []) + ([IgnoreStopwords(stopwords)] if stopwords else [])
    return policy.replace(transformation=None if not parts else parts[0] if len(parts) == 1 else ChainTransformation(parts))


def _same_policy(a: TextConfig, b: TextConfig) -> bool:
    return a.normalization == b.normalization and a.tokenization == b.tokenization


def _rows(df: DataFrame | None) -> DataFrame | None:
    return None if df is None else df.select("token", "rank", "neighbor", "distance")


def fuse_synonyms(tables: list[DataFrame], k: int = 0, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of synonym tables.

    Neighbours score the sum of 1 / (rrf_k + rank), ties by mean distance, then
    name; a token keeps ``k`` of them, or as many as its widest input.  Its
    distances are kept only if every neighbour it keeps has one.
    """
    every = reduce(DataFrame.unionByName, [_rows(t).withColumn("__src", F.lit(i)) for i, t in enumerate(tables)])
    widest = every.groupBy("token", "__src").count().groupBy("token").agg(F.max("count").alias("__wide"))
    fused = every.groupBy("token", "neighbor").agg(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("__score"), F.avg("distance").alias("distance"))
    by = W.partitionBy("token").orderBy(F.desc(F.round("__score", 12)), F.coalesce("distance", F.lit(float("inf"))), "neighbor")
    ranked = fused.withColumn("rank", F.row_number().over(by)).join(widest, "token").where(F.col("rank") <= (F.lit(k) if k else F.col("__wide")))
    whole = F.count("distance").over(W.partitionBy("token")) == F.count(F.lit(1)).over(W.partitionBy("token"))
    return ranked.select("token", "rank", "neighbor", F.when(whole, F.col("distance")).alias("distance"))


def vote_lemmas(maps: list[dict[str, str]], vocab: DataFrame) -> dict[str, str]:
    """Plurality vote of lemma maps, chains followed to their end, cycles settled by the most frequent member.

    Ties go to the most frequent, then shortest, then first lemma.  The votes
    are counted in Spark; following chains is a walk over one row a mapped
    token, which a profile holds in memory anyway.
    """
    spark = vocab.sparkSession
    rows = [(t, lemma) for m in maps for t, lemma in m.items()]
    if not rows:
        return {}
    voc = vocab.select("token", "occs")
    votes = spark.createDataFrame(rows, LEMMAS).groupBy("token", "lemma").count().join(voc.select("token"), "token", "left_semi")
    known = votes.join(voc.select(F.col("token").alias("lemma"), "occs"), "lemma")
    by = W.partitionBy("token").orderBy(F.desc("count"), F.desc("occs"), F.length("lemma"), "lemma")
    won = known.withColumn("__n", F.row_number().over(by)).where("__n = 1").select("token", "lemma", "occs").collect()
    to = {r["token"]: r["lemma"] for r in won}
    count = {r["lemma"]: r["occs"] for r in won}
    out = {}
    for token in to:
        chain, at = [token], token
        while at in to and to[at] != at:
            nxt = to[at]
            if nxt in chain:
                at = min(chain[chain.index(nxt) :], key=lambda t: (-count.get(t, 0), len(t), t))
                break
            chain.append(nxt)
            at = nxt
        if at != token:
            out[token] = at
    return out


def merge_profiles(profiles: list[Profile], doc_freq_threshold: float = 0.5, synonyms_k: int = 0, rrf_k: int = 60) -> Profile:
    """One profile from several of the same policy and weighting: counters add up exactly, weights are computed anew."""
    if len(profiles) < 2:
        raise ValueError("merging needs two profiles at least")
    first = profiles[0]
    for p in profiles:
        if not _same_policy(p.policy, first.policy):
            raise ValueError("profiles differ in normalization or tokenization")
        if (p.model.global_weighting, p.model.local_weighting) != (first.model.global_weighting, first.model.local_weighting):
            raise ValueError("profiles differ in weighting")
        if p.applied != first.applied:
            raise ValueError("profiles differ in what they apply")
    if first.model.global_weighting == "entropy":
        raise ValueError("entropy weights are supervised and can't be merged")
    voc = vb.merge(*[p.model.voc for p in profiles])
    words = frozenset(r["token"] for r in vb.stopword_candidates(voc, doc_freq_threshold).collect()).union(*[p.stopwords for p in profiles])
    lemmas = vote_lemmas([p.lemmas for p in profiles], voc.table)
    own = [p.synonyms for p in profiles if p.synonyms is not None]
    syn = restrict_synonyms(fuse_synonyms([restrict_synonyms(s, voc.table) for s in own], synonyms_k, rrf_k), voc.table) if own else None
    model = vector_model(voc, first.model.global_weighting, first.model.local_weighting)
    return Profile(model, words, lemmas, syn, first.applied, (Step("merge", {"n_sources": len(profiles), "parents": [p.lineage_summary() for p in profiles]}),))


def fold_lemmas(voc: Vocabulary, lemmas: dict[str, str] | DataFrame) -> Vocabulary:
    """Counters of tokens summed onto their lemmas.

    A token whose lemma isn't in the vocabulary is dropped; document counts are
    capped at the number of documents; the statistics stay.
    """
    spark = voc.table.sparkSession
    table = spark.createDataFrame(list(lemmas.items()), LEMMAS) if isinstance(lemmas, dict) else lemmas
    if isinstance(lemmas, dict) and not lemmas:
        return voc
    mapped = voc.table.join(table, "token", "left").select(F.coalesce("lemma", "token").alias("token"), "occs", "ndocs")
    known = mapped.join(voc.table.select("token"), "token", "left_semi")
    sums = known.groupBy("token").agg(F.sum("occs").alias("occs"), F.sum("ndocs").alias("ndocs"))
    n = F.broadcast(voc.stats.select("trainsize"))
    capped = sums.crossJoin(n).select("token", "occs", F.when(F.col("trainsize") > 0, F.least("ndocs", "trainsize")).otherwise(F.col("ndocs")).alias("ndocs"))
    return replace(voc, table=capped)


def blend(base: Vocabulary, sample: Vocabulary, kappa: float = 0, keep_rate: float = 1e-5, keep_floor: int = 3, avgdoclen: str | float = "blend") -> Vocabulary:
    """The sample's counters plus ``kappa`` documents' worth of the base's rates.

    ``kappa`` of 0 or less means as many documents as the sample has.  Tokens
    only in the base need a document rate of ``keep_rate`` and ``keep_floor``
    documents there, and must add something.  numtokens is the sum of all
    occurrences ("blend"), or set so that the average length is the sample's
    ("sample") or a number.
    """
    if not (avgdoclen in ("blend", "sample") or isinstance(avgdoclen, (int, float)) and avgdoclen > 0):
        raise ValueError("avgdoclen must be 'blend', 'sample' or a positive number")
    b = base.stats.select(F.col("trainsize").alias("nb"))
    s = sample.stats.select(F.col("trainsize").alias("ns"), F.col("numtokens").alias("ts"))
    k = F.col("ns").cast("double") if kappa <= 0 else F.lit(float(kappa))
    sizes = b.crossJoin(s).select("nb", "ns", "ts", k.alias("k"), F.bround(F.col("ns") + k).cast("long").alias("n"))
    if sample.trainsize <= 0:
        raise ValueError("the sample has no documents")
    x = sample.table.select("token", F.col("occs").alias("so"), F.col("ndocs").alias("sn"))
    y = base.table.select("token", F.col("occs").alias("bo"), F.col("ndocs").alias("bn"))
    both = x.join(y, "token", "full_outer").crossJoin(F.broadcast(sizes))  # one row

    def share(c: str) -> Column:
        return F.when((F.col("nb") > 0) & F.col(c).isNotNull(), F.col(c) / F.col("nb")).otherwise(0.0)

    add_n, add_o = F.bround(F.col("k") * share("bn")).cast("long"), F.bround(F.col("k") * share("bo")).cast("long")
    kept = F.col("sn").isNotNull() | ((share("bn") >= keep_rate) & (F.col("bn") >= keep_floor) & ((add_n > 0) | (add_o > 0)))
    zero = F.lit(0)
    table = both.where(kept).select("token", (F.coalesce("so", zero) + add_o).alias("occs"), F.least(F.coalesce("sn", zero) + add_n, "n").alias("ndocs")).where("ndocs >= 1")
    if avgdoclen == "blend":
        stats = table.agg(F.coalesce(F.sum("occs"), F.lit(0)).alias("numtokens")).crossJoin(sizes).select(F.col("n").alias("trainsize"), "numtokens")
    else:
        target = F.col("ts") / F.col("ns") if avgdoclen == "sample" else F.lit(float(avgdoclen))
        stats = sizes.select(F.col("n").alias("trainsize"), F.greatest(F.lit(1), F.bround(F.col("n") * target).cast("long")).alias("numtokens"))
    return Vocabulary(table, stats, sample.cfg)


def restrict_synonyms(synonyms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Synonyms with both tokens in the vocabulary, ranked anew."""
    own = vocab.select("token")
    kept = _rows(synonyms).join(own, "token", "left_semi").join(own.withColumnRenamed("token", "neighbor"), "neighbor", "left_semi")
    return kept.select("token", F.row_number().over(W.partitionBy("token").orderBy("rank", "neighbor")).alias("rank"), "neighbor", "distance")


def synonyms_to_lemmas(synonyms: DataFrame, lemmas: dict[str, str] | DataFrame) -> DataFrame:
    """Synonyms with tokens and neighbours replaced by lemmas: the best entry of each pair stays, a token is not its own."""
    spark = synonyms.sparkSession
    table = spark.createDataFrame(list(lemmas.items()), LEMMAS) if isinstance(lemmas, dict) else lemmas
    left = table.select(F.col("token"), F.col("lemma").alias("__a"))
    right = table.select(F.col("token").alias("neighbor"), F.col("lemma").alias("__b"))
    moved = _rows(synonyms).join(left, "token", "left").join(right, "neighbor", "left").select(F.coalesce("__a", "token").alias("token"), F.coalesce("__b", "neighbor").alias("neighbor"), "rank", "distance")
    best = moved.where("token <> neighbor").groupBy("token", "neighbor").agg(F.min("rank").alias("__r"), F.min("distance").alias("distance"))
    by = W.partitionBy("token").orderBy(F.coalesce("distance", F.col("__r").cast("double")), "neighbor")
    return best.select("token", F.row_number().over(by).alias("rank"), "neighbor", "distance")


def refit_config(base: Profile, apply_lemmas: bool = True, lemmas: dict[str, str] | None = None) -> TextConfig:
    """The config a sample must be read with."""
    return materialize(base.policy, (base.lemmas if lemmas is None else lemmas) if apply_lemmas else {}, base.stopwords if base.applied.stopwords else ())


def refit_profile(base: Profile, sample: Vocabulary | DataFrame, kappa: float = 0, apply_lemmas: bool = True, lemmas: dict[str, str] | None = None, keep_rate: float = 1e-5, keep_floor: int = 3, avgdoclen: str | float = "blend", doc_freq_threshold: float = 0.5, extend: bool = False, **morphology) -> Profile:
    """``base`` adapted to a sample (its vocabulary, or documents with a text column).

    The stopwords of the result are those of the base and the candidates of the
    blended vocabulary, so what is applied may grow.
    """
    if base.model.global_weighting == "entropy":
        raise ValueError("entropy weights are supervised and can't be refitted")
    if extend and not apply_lemmas:
        raise ValueError("extending lemmas needs lemmas applied")
    own = dict(base.lemmas if lemmas is None else lemmas)
    if isinstance(sample, DataFrame):
        docs = sample
        sample = vb.vocabulary(docs, refit_config(base, apply_lemmas, own))
        if extend:
            every = vb.merge(base.model.voc, sample)
            new = sample.table.join(base.model.voc.table.select("token"), "token", "left_anti")
            known = base.model.voc.table.sparkSession.createDataFrame(list(own.items()), LEMMAS)
            more = {r["token"]: r["lemma"] for r in extend_lemmas(every.table, known, candidates=new, **morphology).collect()}
            if more:
                own |= more
                sample = vb.vocabulary(docs, refit_config(base, apply_lemmas, own))
    elif sample.cfg != refit_config(base, apply_lemmas, own):
        raise ValueError("the sample was read with another config")
    voc = base.model.voc
    if apply_lemmas and own and not base.applied.lemmas:
        voc = fold_lemmas(voc, own)
    blended = blend(voc, sample, kappa, keep_rate, keep_floor, avgdoclen)
    model = vector_model(blended, base.model.global_weighting, base.model.local_weighting)
    kept = {}
    if own:
        table = blended.table.sparkSession.createDataFrame(list(own.items()), LEMMAS)
        kept = {r["token"]: r["lemma"] for r in table.join(blended.table.select(F.col("token").alias("lemma")), "lemma", "left_semi").collect()}
    words = base.stopwords | {r["token"] for r in vb.stopword_candidates(blended, doc_freq_threshold).collect()}
    syn = restrict_synonyms(base.synonyms, blended.table) if base.synonyms is not None else None
    size = sample.trainsize
    applied = replace(base.applied, lemmas=apply_lemmas and bool(kept))
    step = Step("refit", {"kappa": float(kappa) if kappa > 0 else float(size), "sample_trainsize": size, "trainsize": blended.trainsize, "lemmas_applied": applied.lemmas})
    return Profile(model, frozenset(words), kept, syn, applied, (*base.lineage, step))
