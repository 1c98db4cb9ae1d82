"""Indexes and top-k search.

An index is the term-frequency (or vector) table itself.  A search joins the
queries' tokens to it, sums by (query, document) and ranks; with many queries
the ranking is one window that Spark limits group by group.
"""

from __future__ import annotations

import logging
import math
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators import expansion
from textloom.config import TextConfig
from textloom.operators.ranking import BROADCAST_PAIRS, by_document, first_documents
from textloom.operators.tokens import term_frequencies, tokenize
from textloom.operators.vocabulary import Terms, Vocabulary, bag_of_words, keep_known, terms
from textloom.operators.weighting import VectorModel, unit, vector_model, vectorize, vectorize_bags, vectorize_terms

log = logging.getLogger(__name__)

SET_DISTANCES = ("jaccard", "dice", "intersection", "cosineset")


def is_set_distance(name: str) -> bool:
    return name in SET_DISTANCES


@dataclass(frozen=True)
class BM25Scorer:
    """Coefficients of BM25+."""

    trainsize: Column
    avgdoclen: Column
    k1: float = 1.2
    b: float = 0.75
    delta: float = 1.0

    def token_score(self, ndocs: Column, doclen: Column, tf: Column) -> Column:
        idf = F.log(1 + (self.trainsize - ndocs + 0.5) / (ndocs + 0.5))
        return idf * (tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b) + doclen * self.k1 * self.b / self.avgdoclen) + self.delta)


def scorer(k1: float = 1.2, b: float = 0.75, delta: float = 1.0) -> BM25Scorer:
    """Scorer over the statistics columns trainsize and numtokens."""
    return BM25Scorer(F.col("trainsize"), F.col("numtokens") / F.col("trainsize"), k1, b, delta)


def top_k(scored: DataFrame, k: int, by: Column, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """The k first documents of every query in the order of ``by``, ties by document, with rank from 1."""
    w = W.partitionBy(query).orderBy(by, doc)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(cfg: TextConfig, queries: DataFrame, text: str, **how) -> DataFrame:
    """(token) of all queries."""
    return term_frequencies(tokenize(queries, cfg, text, **how), keys=()).select("token").distinct()


def _rows_of(table: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of ``table`` for the tokens of queries, at hand."""
    return table.sparkSession.createDataFrame(table.join(F.broadcast(tokens), "token", "left_semi").toArrow())


@dataclass(frozen=True)
class BM25Index:
    """Postings (doc_id, token, tf) with document lengths, scored against a vocabulary.

    The vocabulary's statistics, not those of the indexed documents, set the
    weights; the index may hold documents the vocabulary never saw.
    """

    voc: Vocabulary
    postings: DataFrame | None = None
    k1: float = 1.2
    b: float = 0.75
    delta: float = 1.0
    synonyms: DataFrame | None = None
    events: list = field(default_factory=list, compare=False)
    #: Drop the postings of other tokens before the join; for indexes much larger than what queries touch.
    prune: bool = False
    #: The same postings as one row a document (``Terms.rows``), where they come so.
    rows: DataFrame | None = None

    def append(self, docs: DataFrame, text: str = "text", **how) -> BM25Index:
        """Index documents (doc_id, text) in one pass."""
        return self.append_bags(bag_of_words(self.voc, docs, text, **how))

    def append_bags(self, bags: DataFrame, minimum: float = 0) -> BM25Index:
        """Index bags (doc_id, token, tf); unknown tokens and frequencies of ``minimum`` or less are dropped."""
        own = keep_known(bags.where(F.col("tf") > minimum), self.voc).select("doc_id", "token", "tf")
        own = own.withColumn("doclen", F.sum("tf").over(W.partitionBy("doc_id")))
        self.events.append("add")
        log.info("add: documents appended")
        return replace(self, postings=own if self.postings is None else self.postings.unionByName(own), rows=None)

    def append_terms(self, terms: Terms) -> BM25Index:
        """Index stored terms; those of the vocabulary's own documents need neither a join nor a sum."""
        if self.voc.terms is not terms:
            return self.append_bags(terms.bags.select("doc_id", "token", "tf"))
        self.events.append("add")
        log.info("add: documents appended")
        own = terms.bags.select("doc_id", "token", "tf", "doclen")
        rows = terms.rows if self.postings is None and terms.unique else None
        return replace(self, postings=own if self.postings is None else self.postings.unionByName(own), rows=rows)

    def push(self, text: str, doc_id=None, minimum: float = 0, **how) -> BM25Index:
        """Index one document; its id is the number of indexed documents plus one unless given."""
        spark = self.voc.table.sparkSession
        kind = dict(self.postings.dtypes)["doc_id"] if self.postings is not None else "long"
        one = spark.createDataFrame([(len(self) + 1 if doc_id is None else doc_id, text)], f"doc_id {kind}, text string")
        return self.append_bags(bag_of_words(self.voc, one, **how), minimum)

    def catch_up(self, stored: DataFrame) -> BM25Index:
        """Index the stored bags of documents after the last indexed one; nothing to do gives the same index."""
        last = self.postings.agg(F.max("doc_id")).first()[0] if self.postings is not None else None
        fresh = stored if last is None else stored.where(F.col("doc_id") > last)
        return self if fresh.isEmpty() else self.append_bags(fresh)

    def __len__(self) -> int:
        return 0 if self.postings is None else self.postings.select("doc_id").distinct().count()

    def select_postings(self, tokens: DataFrame) -> DataFrame:
        """Postings of the given tokens."""
        return self.postings.join(tokens.select("token").distinct(), "token", "left_semi")

    def query_bags(self, queries: DataFrame, text: str = "text", **how) -> DataFrame:
        """(query_id, token): distinct known tokens of each query, with synonyms where the index has them."""
        bags = bag_of_words(self.voc, queries.withColumnRenamed("query_id", "doc_id"), text, **how).withColumnRenamed("doc_id", "query_id")
        if self.synonyms is not None:
            bags = expansion.expand_bags(bags, self.voc, self.synonyms, key="query_id")
        return bags.select("query_id", "token").distinct()

    def scores(self, query_tokens: DataFrame, t: int = 1) -> DataFrame:
        """(query_id, doc_id, score) of documents with at least ``t`` of the query's tokens."""
        s = scorer(self.k1, self.b, self.delta)
        known = query_tokens.join(self.voc.with_stats().select("token", "ndocs", "trainsize", "numtokens"), "token")
        hits = self.select_postings(known).join(known, "token") if self.prune else self.postings.join(known, "token")
        each = hits.select("query_id", "doc_id", s.token_score(F.col("ndocs"), F.col("doclen"), F.col("tf")).alias("s"))
        out = each.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("hits"))
        return out.where(F.col("hits") >= t).select("query_id", "doc_id", "score")

    def search(self, queries: DataFrame, k: int = 10, t: int = 1, text: str = "text", digits: int = 6, **how) -> DataFrame:
        """(query_id, rank, doc_id, score, dist): the k best documents of each query (query_id, text); dist = -score.

        Scores are rounded before ranking, so that ties don't depend on the
        order of summation.  Fewer matches give fewer rows.
        """
        if self.postings is not None and (found := self._first(queries, k, t, text, digits, **how)) is not None:
            return found.select("query_id", "rank", "doc_id", (-F.col("dist")).alias("score"), "dist")
        found = self.scores(self.query_bags(queries, text, **how), t).withColumn("score", F.round("score", digits))
        return top_k(found, k, F.desc("score")).select("query_id", "rank", "doc_id", "score", (-F.col("score")).alias("dist"))


    def _first(self, queries: DataFrame, k: int, t: int, text: str, digits: int, **how) -> DataFrame | None:
        """The search document by document; None where queries are too many for it."""
        asked = queries.withColumnRenamed("query_id", "doc_id")
        synonyms = self.synonyms
        if synonyms is not None:
            more = synonyms.join(_asked(self.voc.cfg, asked, text, **how), "token", "left_semi").select(F.col("neighbor").alias("token"))
            words = _asked(self.voc.cfg, asked, text, **how).union(more).distinct()
        else:
            words = _asked(self.voc.cfg, asked, text, **how)
        table, stats = _rows_of(self.voc.table.select("token", "ndocs"), words), self.voc.stats.first()
        pairs = replace(self, voc=replace(self.voc, table=table)).query_bags(queries, text, **how).take(BROADCAST_PAIRS + 1)
        if len(pairs) > BROADCAST_PAIRS or not pairs or not stats["trainsize"]:
            return None
        ndocs = {r["token"]: r["ndocs"] for r in table.collect()}
        n, mean = stats["trainsize"], stats["numtokens"] / stats["trainsize"]
        weighted = [(r["query_id"], r["token"], math.log(1 + (n - ndocs[r["token"]] + 0.5) / (ndocs[r["token"]] + 0.5))) for r in pairs]
        factor = lambda tf, length: tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b) + length * self.k1 * self.b / mean) + self.delta
        if self.rows is not None:
            docs = self.rows.select("doc_id", F.transform("terms", lambda x: x["token"]).alias("tokens"), F.transform("terms", lambda x: factor(x["tf"], F.col("doclen"))).alias("x"), F.lit(0.0).alias("extra"))
        else:
            docs = by_document(self.postings, table, factor(F.col("tf"), F.col("doclen")))
        return first_documents(docs, weighted, k, t, digits, lambda dots, hits, extra, q: -dots, dict(queries.dtypes)["query_id"])


def bm25_score(index: BM25Index, query: str, spark=None) -> DataFrame:
    """(doc_id, score) of one query over all documents it touches."""
    spark = spark or index.postings.sparkSession
    q = spark.createDataFrame([(0, query)], "query_id int, text string")
    return index.scores(index.query_bags(q)).select("doc_id", "score")


def set_distance(kind: str, inter, a, b, of=F):
    """Distance of two sets from the sizes of their intersection and of both; ``of``: numpy for arrays."""
    if kind == "jaccard":
        return 1 - inter / (a + b - inter)
    if kind == "dice":
        return 1 - 2 * inter / (a + b)
    if kind == "intersection":
        return 1 - inter / (F.greatest(a, b) if of is F else of.maximum(a, b))
    if kind == "cosineset":
        return 1 - inter / of.sqrt(a * b)
    raise ValueError(f"unknown set distance {kind!r}")


@dataclass(frozen=True)
class TextIndex:
    """Cosine search over weighted vectors, or set distances over bags."""

    model: VectorModel
    dist: str = "cosine"
    items: DataFrame | None = None
    synonyms: DataFrame | None = None
    #: The same items of a set distance as one row a document (``Terms.rows``), where they come so.
    rows: DataFrame | None = None

    def __post_init__(self):
        if self.dist != "cosine" and not is_set_distance(self.dist):
            raise ValueError(f"unknown distance {self.dist!r}")

    def _encode(self, docs: DataFrame, text: str, **how) -> DataFrame:
        if is_set_distance(self.dist):
            return bag_of_words(self.model.voc, docs, text, **how).select("doc_id", "token", F.lit(1.0).alias("w"))
        return vectorize(self.model, docs, text, **how)

    def append(self, docs: DataFrame, text: str = "text", **how) -> TextIndex:
        return self.append_vectors(self._encode(docs, text, **how))

    def append_terms(self, terms: Terms) -> TextIndex:
        """Index stored terms."""
        if not is_set_distance(self.dist):
            return self.append_vectors(vectorize_terms(self.model, terms))
        own = terms.bags if self.model.voc.terms is terms else keep_known(terms.bags, self.model.voc)
        rows = terms.rows if self.items is None and self.model.voc.terms is terms and terms.unique else None
        return replace(self.append_vectors(own.select("doc_id", "token", F.lit(1.0).alias("w"))), rows=rows)

    def append_vectors(self, vec: DataFrame) -> TextIndex:
        """Append encoded items (doc_id, token, w)."""
        vec = vec.select("doc_id", "token", "w")
        return replace(self, items=vec if self.items is None else self.items.unionByName(vec), rows=None)

    def search(self, queries: DataFrame, k: int = 10, t: int = 1, text: str = "text", digits: int = 6, **how) -> DataFrame:
        """(query_id, rank, doc_id, dist) of the k nearest items that share at least ``t`` tokens with the query."""
        q = queries.withColumnRenamed("query_id", "doc_id")
        words = _asked(self.model.voc.cfg, q, text, **how)
        if self.synonyms is not None:
            words = words.union(self.synonyms.join(words, "token", "left_semi").select(F.col("neighbor").alias("token"))).distinct()
        # what the queries touch of the model
        weights = _rows_of(self.model.weights, words)
        model = replace(self.model, voc=replace(self.model.voc, table=weights, terms=None), weights=weights)
        if is_set_distance(self.dist):
            qv = replace(self, model=model)._encode(q, text, **how)
        else:
            qv = vectorize_bags(model, bag_of_words(model.voc, q, text, **how), normalize=False)
            qv = unit(qv) if self.synonyms is None else expansion.expand_vectors(qv, model.voc, self.synonyms)
        qv = qv.select(F.col("doc_id").alias("query_id"), "token", F.col("w").alias("__q"))
        pairs = [tuple(r) for r in qv.take(BROADCAST_PAIRS + 1)]
        if pairs and len(pairs) <= BROADCAST_PAIRS:
            kind = dict(queries.dtypes)["query_id"]
            if not is_set_distance(self.dist):
                docs = by_document(self.items, weights, F.col("w"))
                return first_documents(docs, pairs, k, t, digits, lambda dots, hits, extra, own: 1 - dots, kind)
            if self.rows is not None:
                docs = self.rows.select("doc_id", F.transform("terms", lambda x: x["token"]).alias("tokens"), F.transform("terms", lambda x: F.lit(1.0)).alias("x"), F.size("terms").cast("double").alias("extra"))
            else:
                docs = by_document(self.items, weights, F.col("w"), F.count(F.lit(1)))
            sizes = np.array(list(Counter(q for q, _, _ in pairs).values()), float)
            name = self.dist
            return first_documents(docs, pairs, k, t, digits, lambda dots, hits, extra, own: set_distance(name, dots, sizes[own][None], extra, np), kind)
        hits = self.items.join(qv, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("__q")).alias("dot"), F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= t)
        if is_set_distance(self.dist):
            a = qv.groupBy("query_id").agg(F.count(F.lit(1)).alias("__a"))
            b = self.items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__b"))
            hits = hits.join(a, "query_id").join(b, "doc_id").withColumn("dist", set_distance(self.dist, F.col("dot"), F.col("__a"), F.col("__b")))
        else:
            hits = hits.withColumn("dist", 1 - F.col("dot"))
        return top_k(hits.withColumn("dist", F.round("dist", digits)), k, F.asc("dist")).select("query_id", "rank", "doc_id", "dist")


def index_of_vocabulary(voc: Vocabulary, global_weighting: str = "idf", local_weighting: str = "tf", **how) -> TextIndex:
    """An empty index over a model of the vocabulary."""
    return TextIndex(vector_model(voc, global_weighting, local_weighting), **how)


def index_of_corpus(cfg: TextConfig, docs: DataFrame, global_weighting: str = "idf", local_weighting: str = "tf", text: str = "text", **how) -> TextIndex:
    """An empty index over a model of the documents' vocabulary; the documents themselves are not indexed."""
    docs = docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.monotonically_increasing_id())
    return index_of_vocabulary(terms(docs, cfg, text).vocabulary(), global_weighting, local_weighting, **how)


def intersect(postings: list[DataFrame], column: str = "id") -> DataFrame:
    """Ids in all lists."""
    out = postings[0].select(column)
    for p in postings[1:]:
        out = out.intersect(p.select(column))
    return out


def union(postings: list[DataFrame], column: str = "id", t: int = 1) -> DataFrame:
    """Ids in at least ``t`` of the lists."""
    tagged = [p.select(column).distinct() for p in postings]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p)
    return every.groupBy(column).count().where(F.col("count") >= t).select(column)


def grep(docs: DataFrame, query_tokens: list[str], t: int = 1, tokens: str = "tokens", mode: str = "count") -> DataFrame:
    """Rows whose tokens hold at least ``t`` occurrences ("count") or distinct members ("set") of the query."""
    if mode not in ("count", "set"):
        raise ValueError(f"unknown mode {mode!r}")
    words = sorted(set(query_tokens))
    if not words:
        return docs.where(F.lit(False)) if t > 0 else docs
    column = F.col(tokens) if mode == "count" else F.array_distinct(tokens)
    if t == 1:
        return docs.where(F.exists(column, lambda x: x.isin(words)))
    return docs.where(F.size(F.filter(column, lambda x: x.isin(words))) >= t)
