"""Vocabularies: tokens with their occurrences and document counts, and a row of corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.config import TextConfig
from textloom.operators.tokens import count_in_row, term_frequencies, tokenize
from textloom.scratch import Scratch

VOCAB = "token string, occs long, ndocs long"
STATS = "trainsize long, numtokens long"


@dataclass(frozen=True)
class Vocabulary:
    """``table`` (token, occs, ndocs) and the one-row ``stats`` (trainsize, numtokens).

    ``numtokens`` counts distinct (document, token) pairs, so the average
    document length is in distinct tokens.
    """

    table: DataFrame
    stats: DataFrame
    cfg: TextConfig
    #: Stored terms of which this is the whole vocabulary, if known: nothing of theirs is unknown to it.
    terms: object = None

    @property
    def trainsize(self) -> int:
        return self.stats.first()["trainsize"]

    @property
    def numtokens(self) -> int:
        return self.stats.first()["numtokens"]

    @property
    def avgdoclen(self) -> float:
        r = self.stats.first()
        return r["numtokens"] / r["trainsize"] if r["trainsize"] else 0.0

    @property
    def vocsize(self) -> int:
        return self.table.count()

    def with_stats(self) -> DataFrame:
        """The table with both statistics on every row (one row is broadcast)."""
        return self.table.crossJoin(F.broadcast(self.stats))

    def get(self, token: str) -> dict:
        """Row of a token; zeros if it isn't in the vocabulary."""
        r = self.table.where(F.col("token") == token).first()
        return r.asDict() if r else {"token": "", "occs": 0, "ndocs": 0}

    def with_ids(self) -> DataFrame:
        """The table with token_id from 1, most frequent first, ties by token.

        Tokens of one frequency are ranked among themselves and follow the
        number of those before, so no task holds the whole vocabulary; only the
        tokens of one frequency meet, in parts by their first characters.
        """
        own = self.table.withColumn("__part", F.substring("token", 1, 2))
        sizes = own.groupBy("occs", "__part").agg(F.count(F.lit(1)).alias("__n"))
        # few rows: the distinct frequencies times the distinct beginnings
        before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy(F.desc("occs"), "__part")) - F.col("__n")).drop("__n")
        ranked = own.withColumn("__rank", F.row_number().over(W.partitionBy("occs", "__part").orderBy("token")))
        return ranked.join(before, ["occs", "__part"]).withColumn("token_id", (F.col("__before") + F.col("__rank")).cast("int")).select(*self.table.columns, "token_id")

    def select(self, tokens: list[str] | DataFrame) -> DataFrame:
        """Rows of a list of tokens, or of the ``token`` column of a bag or any other table; unknown ones give none."""
        if isinstance(tokens, DataFrame):
            return self.table.join(tokens.select("token").distinct(), "token", "left_semi")
        return self.table.where(F.col("token").isin(list(tokens)))

    def select_ids(self, ids: list[int] | DataFrame, column: str = "token_id") -> DataFrame:
        """Rows, with token_id, of a list of ids or of a column of ids, such as that of a search result."""
        every = self.with_ids()
        if isinstance(ids, DataFrame):
            return every.join(ids.select(F.col(column).alias("token_id")).distinct(), "token_id", "left_semi")
        return every.where(F.col("token_id").isin(list(ids)))

    def filter(self, predicate: Column | str) -> Vocabulary:
        """Tokens that satisfy a predicate over token, occs, ndocs; the statistics stay those of the whole."""
        return replace(self, table=self.table.where(predicate), terms=None)


def from_tokens(tokens: DataFrame, cfg: TextConfig, column: str = "tokens") -> Vocabulary:
    """Vocabulary of rows of tokens, one shuffle by token with partial sums.

    Sorting each row's tokens tells the first of each from the others, so
    occurrences and documents are counted together.
    """
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice("__sorted", 1, F.size("__sorted") - 1))
    ordered = tokens.where(F.size(column) > 0).select(F.sort_array(column).alias("__sorted"))
    flagged = ordered.select(F.explode(F.zip_with("__sorted", prev, lambda a, b: F.struct(a.alias("token"), F.when(a.eqNullSafe(b), 0).otherwise(1).alias("new")))).alias("t"))
    table = flagged.groupBy(F.col("t.token").alias("token")).agg(F.count(F.lit(1)).alias("occs"), F.sum("t.new").alias("ndocs"))
    stats = tokens.agg(F.count(F.lit(1)).alias("trainsize"), F.coalesce(F.sum(F.when(F.size(column) > 0, F.size(F.array_distinct(column)))), F.lit(0)).cast("long").alias("numtokens"))
    return Vocabulary(table, stats, cfg)


def vocabulary(docs: DataFrame, cfg: TextConfig, text: str = "text", min_ndocs: int = 1, **how) -> Vocabulary:
    """Vocabulary of a corpus, without tokens of fewer than ``min_ndocs`` documents."""
    voc = from_tokens(tokenize(docs, cfg, text, **how).select("tokens"), cfg)
    if min_ndocs > 1:
        voc = voc.filter(F.col("ndocs") >= min_ndocs)
        if voc.table.isEmpty():
            raise ValueError(f"no token occurs in {min_ndocs} documents")
    return voc


@dataclass(frozen=True)
class Terms:
    """Documents tokenized once: ``bags`` (doc_id, token, tf, doclen) as a stored table, and their number.

    doclen is the sum of tf over the tokens of the row, whether a vocabulary
    knows them or not.  Everything that is counted or
    weighted over a corpus derives from this table.  It is stored as ``rows``
    (doc_id, doclen, maxtf, terms array of (token, tf)), one a document.
    """

    rows: DataFrame
    size: int
    cfg: TextConfig

    @property
    def bags(self) -> DataFrame:
        return self.rows.select("doc_id", "doclen", "maxtf", F.explode("terms").alias("__c")).select("doc_id", "__c.token", "__c.tf", "doclen", "maxtf")

    @cached_property
    def numtokens(self) -> int:
        return self.rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]

    @cached_property
    def unique(self) -> bool:
        """Whether no two documents share an id."""
        return self.rows.groupBy("doc_id").count().where("count > 1").isEmpty()

    def vocabulary(self, min_ndocs: int = 1) -> Vocabulary:
        """Vocabulary of the documents, without tokens of fewer than ``min_ndocs``."""
        table = self.bags.groupBy("token").agg(F.sum("tf").alias("occs"), F.count(F.lit(1)).alias("ndocs"))
        stats = self.rows.sparkSession.createDataFrame([(self.size, self.numtokens)], STATS)
        voc = Vocabulary(table, stats, self.cfg, self)
        if min_ndocs > 1:
            voc = voc.filter(F.col("ndocs") >= min_ndocs)
            if voc.table.isEmpty():
                raise ValueError(f"no token occurs in {min_ndocs} documents")
        return voc


def terms(docs: DataFrame, cfg: TextConfig, text: str = "text", key: str = "doc_id", **how) -> Terms:
    """Tokenize documents (key and a text column) and store their bags in the shared folder."""
    rows = tokenize(docs.select(key, text), cfg, text, **how).where(F.size("tokens") > 0)
    ordered = rows.select(F.col(key).alias("doc_id"), F.sort_array("tokens").alias("__sorted"), F.size("tokens").cast("long").alias("doclen"))
    counted = ordered.select("doc_id", "doclen", count_in_row("__sorted").alias("terms"))
    stored = Scratch(docs.sparkSession, "terms").write(counted.select("doc_id", "doclen", F.array_max(F.transform("terms", lambda x: x["tf"])).alias("maxtf"), "terms"), "rows")
    return Terms(stored, docs.count(), cfg)


def empty(spark: SparkSession, cfg: TextConfig, trainsize: int = 0, numtokens: int = 0) -> Vocabulary:
    """A vocabulary without tokens."""
    return Vocabulary(spark.createDataFrame([], VOCAB), spark.createDataFrame([(trainsize, numtokens)], STATS), cfg)


def from_thesaurus(spark: SparkSession, cfg: TextConfig, tokens: list[str]) -> Vocabulary:
    """A vocabulary of listed tokens: one occurrence and document each time a token is listed."""
    rows = spark.createDataFrame([(t,) for t in tokens], "token string")
    table = rows.groupBy("token").agg(F.count(F.lit(1)).alias("occs"), F.count(F.lit(1)).alias("ndocs"))
    return Vocabulary(table, spark.createDataFrame([(len(tokens), len(tokens))], STATS), cfg)


def _sum(tables: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, [t.select("token", "occs", "ndocs") for t in tables])
    return every.groupBy("token").agg(F.sum("occs").alias("occs"), F.sum("ndocs").alias("ndocs"))


def push_tokens(voc: Vocabulary, rows: DataFrame) -> Vocabulary:
    """Add counters (token, occs, ndocs); the statistics stay."""
    return replace(voc, table=_sum([voc.table, rows]), terms=None)


def append(voc: Vocabulary, docs: DataFrame, text: str = "text", **how) -> Vocabulary:
    """Add the tokens of more documents; numtokens grows, trainsize is left to the caller."""
    own = vocabulary(docs, voc.cfg, text, **how)
    stats = voc.stats.crossJoin(F.broadcast(own.stats.select(F.col("numtokens").alias("__n")))).select("trainsize", (F.col("numtokens") + F.col("__n")).alias("numtokens"))
    return replace(voc, table=_sum([voc.table, own.table]), stats=stats, terms=None)


def update(voc: Vocabulary, other: Vocabulary, predicate: Column | str | None = None) -> Vocabulary:
    """Add the counters of another vocabulary's tokens that satisfy ``predicate``; the statistics stay."""
    return push_tokens(voc, other.table.where(predicate) if predicate is not None else other.table)


def merge(*vocs: Vocabulary, predicate: Column | str | None = None) -> Vocabulary:
    """Sum of vocabularies and of their statistics."""
    table = _sum([v.table for v in vocs])
    stats = reduce(DataFrame.unionByName, [v.stats for v in vocs]).agg(F.sum("trainsize").alias("trainsize"), F.sum("numtokens").alias("numtokens"))
    return Vocabulary(table.where(predicate) if predicate is not None else table, stats, vocs[0].cfg)


def keep_known(tokens: DataFrame, voc: Vocabulary, token: str = "token") -> DataFrame:
    """Rows whose token is in the vocabulary."""
    return tokens.join(voc.table.select(F.col("token").alias(token)), token, "left_semi")


def encode(bag: DataFrame, voc: Vocabulary) -> DataFrame:
    """(token, value) to (token_id, value); unknown tokens gather under id 0."""
    ids = voc.with_ids().select("token", "token_id")
    return bag.join(ids, "token", "left").groupBy(F.coalesce("token_id", F.lit(0)).alias("token_id")).agg(F.sum("value").alias("value"))


def decode(bag: DataFrame, voc: Vocabulary) -> DataFrame:
    """(token_id, value) to (token, value); id 0 becomes the empty token."""
    ids = voc.with_ids().select("token", "token_id")
    return bag.join(ids, "token_id", "left").select(F.coalesce("token", F.lit("")).alias("token"), "value")


def stopword_candidates(voc: Vocabulary, threshold: float = 0.5) -> DataFrame:
    """(token, ratio) of tokens in more than ``threshold`` of the documents, most frequent first, ties by token descending."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    ratio = voc.with_stats().where("trainsize > 0").select("token", (F.col("ndocs") / F.col("trainsize")).alias("ratio"))
    return ratio.where(F.col("ratio") > threshold).orderBy(F.desc("ratio"), F.desc("token"))


def bag_of_words(voc: Vocabulary, docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """(doc_id, token, tf) over tokens of the vocabulary."""
    return keep_known(term_frequencies(tokenize(docs, voc.cfg, text, **how)), voc)


def pack(bag: DataFrame, key: str = "doc_id", name: str = "token", value: str = "tf") -> DataFrame:
    """One map a document."""
    return bag.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value)))).alias("bow"))
