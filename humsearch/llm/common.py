"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What separates words, here and in the contracts: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a laptop) a temporary folder is
    made once and set, so that later calls find it; on a cluster that is an error,
    as executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Where the tables that ``keep`` has written lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor and
    never computes ``df`` again. The table lives as long as the folder does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _PATHS[kept] = path
    return kept


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``keep`` wrote and no later plan reads; others are left alone."""
    for table in tables:
        path = _PATHS.pop(table, None) if table is not None else None
        if path:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def learns(doc_id: str | Column = "doc_id") -> Column:
    """True for rows whose label may be learned from: crc32(doc_id) mod 5 is not 0."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 != 0


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with one row for each doc_id; where rows disagree, the larger label counts."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit words that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
