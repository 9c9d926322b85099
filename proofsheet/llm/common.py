"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space other than the plain space: \x09-\x0D.
CONTROL_SPACES = "\t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, one is made beside the warehouse, which all
    executors share too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return re.sub("^file:/(?!/)", "file:///", found.rstrip("/"))


#: Intermediate tables of this process that still lie in the shared folder.
_paths: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _paths.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _paths:
        _paths.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables that this process has written; results that are not written yet need them."""
    for path in list(_paths):
        remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later steps start from files, not lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROW = "whole_row"


def wrapped(docs: DataFrame, **extra: Column) -> DataFrame:
    """docs as one struct column, with the extra columns beside it: no name of docs can clash with names used inside."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *[c.alias(n) for n, c in extra.items()])


def unwrapped(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of the wrapped rows, some replaced."""
    return df.select(*[(new[c] if c in new else F.col(ROW).getField(c)).alias(c) for c in columns])


#: Bytes of an Arrow batch, which the JVM and a Python worker both hold; the session's setting if it was set to anything.
BATCH_BYTES = 4 << 20
_BATCH, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, unless a bound was chosen for it."""
    if spark.conf.get(_BATCH) == _UNSET:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: A key with over one MAX_HEAVY-th of all rows, and over MIN_HEAVY rows, is heavy: there are fewer than MAX_HEAVY of them.
MAX_HEAVY, MIN_HEAVY = 1000, 1000


def skew_join(left: DataFrame, right: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of left to right, which has each key once and says in column n how many rows of left have it.

    The rows of right with a heavy key, fewer than MAX_HEAVY, are broadcast, so that no task gets all rows of such a key;
    the others are shuffled. Column n is dropped.
    """
    total, most = right.agg(F.sum(n), F.max(n)).first()
    limit = max(MIN_HEAVY, (total or 0) // MAX_HEAVY)
    if (most or 0) <= limit:
        return left.join(right.drop(n), on)
    heavy = right.filter(F.col(n) > limit).drop(n)
    others = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.filter(F.col(n) <= limit).drop(n), on)
    return left.join(F.broadcast(heavy), on).unionByName(others)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null where the id is null."""
    return F.crc32(doc_id.cast("string")) % modulus


def count_char(text: Column, chars: str) -> Column:
    """How many of these ASCII characters text holds. replace() compares bytes, so it beats a regex here."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def plain_spaces(text: Column) -> Column:
    for c in CONTROL_SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space."""
    return F.filter(F.split(plain_spaces(text), " "), lambda w: w != "")
