"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns all rows it keeps with the
columns of ``documents``; the last returns token ids and training positions
instead.  Between stages the rows are written as Parquet to the shared folder,
so a lost executor costs one stage's tasks at most.

Each stage states below what it does with null columns, empty and very long
texts, ties, repeated rows, empty tables and further columns.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import exact, mixing, pieces, quality, simhash
from textloom.llm._shared import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among ``docs``.

    Rows whose text is null, empty or without a word are rejected; texts are
    scored whole; a score equal to the threshold is accepted; repeated rows are
    judged alike and all kept or all rejected; a null id only keeps a row from
    being fitted on.  An empty table, or one without labelled texts, rejects
    nothing but texts without a word.  Further columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.fit(docs, labels), keep_columns=True)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts, that of least id.

    Of rows that repeat id and text one stays (the first by its other columns);
    rows with a null id or text stay; empty texts equal each other; texts are
    compared whole.  An empty table stays empty; further columns pass through.
    """
    return exact.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least id.

    Rows with a null id or text, and texts without a word, stay; rows that
    share an id are one document and stay or go together; texts are read
    whole.  An empty table stays empty; further columns pass through.
    """
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with a token, in training order under the source curriculum.

    The order is that of the rows in the DataFrame and in the files it is
    written to.  Rows of one time follow their ids; a null source is a source
    of its own; null, empty and blank texts have no token and go; repeated rows
    follow each other.  An empty table stays empty; further columns pass through.
    """
    return mixing.mix(docs, whole=True)


def training_position(docs: DataFrame) -> Column:
    """Number that orders the rows of ``docs`` as they were written: file by file, row by row.

    Files that Spark writes are numbered in the order of the rows.  Rows that
    come from no file are numbered by partition.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long")
    return F.shiftleft(F.coalesce(part, F.lit(0).cast("long")), 33) + F.col("_metadata.row_index")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, the text decoded from them, its source and language, and its position in the training order.

    ``position`` ascends in the order of the rows of ``docs``.  A null text has
    null tokens, an empty one none; texts are encoded whole; repeated rows are
    encoded alike; an empty table stays empty; further columns are not read.
    """
    row = docs.select("doc_id", "lang", "source", "text", training_position(docs).alias("position"))
    return pieces.encode(row, keep=("lang", "source", "position"))


STAGES = [
    ("quality", keep_quality),
    ("exact", drop_exact),
    ("near", drop_near),
    ("mix", mix_sources),
    ("tokenize", tokenize),
]

#: A fitted classifier, fingerprints and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
