"""Corpus records: the text column is named, all other fields ride along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.tokenize import paragraphs_col

FORMATS = ("plaintext", "jsonl", "csv", "parquet", "json")
#: What stands for null in CSV, so that empty texts stay texts; empty fields without quotes are null as well.
CSV_NULL = "\x01\x00null\x01"


def read_records(spark: SparkSession, fmt: str, path: str, text_key: str = "text") -> DataFrame:
    """A corpus in one of FORMATS, with the text in column ``text_key``.

    "plaintext" gives one row a paragraph of each file; "jsonl" skips blank
    lines; "csv" has a header and quoted line breaks, and tells "" from an empty
    field, which is null; "json" is one array of objects a file.
    """
    if fmt == "plaintext":
        files = spark.read.text(path, wholetext=True)
        return files.select(F.explode(paragraphs_col("value")).alias(text_key))
    if fmt == "jsonl":
        df = spark.read.json(path)
    elif fmt == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", CSV_NULL).csv(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        df = spark.read.option("multiLine", True).json(path)
    else:
        raise ValueError(f"unknown corpus format {fmt!r}; supported: {', '.join(FORMATS)}")
    if text_key not in df.columns:
        raise ValueError(f"the corpus has no field {text_key!r}")
    return df


def select_text(df: DataFrame, text_column: str = "text", min_chars: int = 0, keep_columns: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Rows with a text of ``min_chars`` characters at least, as ``text`` and the columns to keep; ``limit`` is a sampling option."""
    own = F.col(f"`{text_column}`")
    out = df.where(own.isNotNull() & (F.length(own) >= min_chars)).select(own.alias("text"), *[f"`{c}`" for c in keep_columns if c != "text"])
    return out if limit is None else out.limit(limit)


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV that ``read_records`` reads back as they are: all quoted, blanks at both ends kept, nulls as CSV_NULL."""
    how = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": CSV_NULL, "emptyValue": ""}
    df.write.options(**how).csv(path)


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON object a row; ``order`` names a column that orders the whole output."""
    (df.orderBy(order) if order else df).select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(token, emb) of a JSON file that maps tokens to vectors."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("token", "emb"))
