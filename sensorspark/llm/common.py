"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import string
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.session import checkpoint_dir, remove_path

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_FOLDERS: list[str] = []


@contextmanager
def scratch(spark: SparkSession, name: str):
    """Tables that ``persist`` writes inside are deleted at the end; what they
    were for must be stored elsewhere by then."""
    folder = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    try:
        yield
    finally:
        _FOLDERS.remove(folder)
        remove_path(spark, folder)


def persist(df: DataFrame, tag: str, partition_by=()) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    This cuts the lineage at a table that every executor can read, so a lost
    executor costs only the tasks in flight.  Without ``scratch`` the table stays
    (a caller may still read what is made from it).
    """
    spark = df.sparkSession
    folder = _FOLDERS[-1] if _FOLDERS else f"{checkpoint_dir(spark)}/llm"
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete a table that ``persist`` wrote, or one of its partitions (name=value),
    when nothing reads it any more."""
    files = df.inputFiles()
    if files:
        folder = re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", files[0])
        remove_path(df.sparkSession, f"{folder}/{part}".rstrip("/"))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so when the driver collects its garbage, which a large heap may put
    off for the whole job; between steps whose results are stored tables this
    asks for it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hashed_sample(df: DataFrame, columns, n: int) -> DataFrame:
    """At most ``n`` distinct rows of ``columns``: the first by a hash of them,
    with the hash as ``h``.

    The number of distinct rows (one pass) gives the hash below which about
    2 n of them lie; only those are compared, so what is gathered does not
    grow with the table or its tasks, nor with the copies of a row.
    """
    d = df.select(F.xxhash64(*columns).alias("h"), *columns)
    total = d.agg(F.approx_count_distinct("h")).first()[0]
    if total > 2 * n:
        d = d.filter(F.col("h") <= F.lit(int(-(1 << 63) + (1 << 64) * (2 * n / total))))
    return d.groupBy("h").agg(*[F.first(c).alias(c) for c in columns]).orderBy("h").limit(n)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``; NULL for a NULL id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def let(value: Column, body) -> Column:
    """Bind ``value`` once as a lambda variable (a plain column would be
    inlined, and evaluated again, wherever ``body`` uses it)."""
    return F.transform(F.array(value), body)[0]
