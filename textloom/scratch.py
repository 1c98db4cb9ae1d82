"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where the setting is absent and the session is local (one process, as in
    tests) a temporary folder is made once and stored in the session, so later
    calls agree on it.  On a cluster its absence is an error: executors would
    each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path with or without a scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, wherever the path leads."""
    fs, p = files(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = files(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = files(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of all files below a folder, relative to it, sorted."""
    fs, p = files(spark, path)
    found, out = fs.listFiles(p, True), []
    base = str(fs.makeQualified(p).toString()).rstrip("/") + "/"
    while found.hasNext():
        out.append(str(found.next().getPath().toString()).removeprefix(base))
    return sorted(out)


class Scratch:
    """Tables of one call: written once, read back without lineage.

    A lost executor costs nothing here: the files are committed by Spark's
    writer to the shared folder and are read again by whichever task needs them.
    What the result still reads is deleted when the driver ends, the rest by
    ``drop`` as soon as its last reader is done.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/textloom/{label}-{uuid.uuid4().hex}"
        fs, p = files(spark, self.path)
        fs.deleteOnExit(p)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Store ``df`` as Parquet and return it as read back."""
        schema = df.schema
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            fs, p = files(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)
