"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the query contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; texts are long, so a batch stays at a few MB.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows (so the memory) of the batches that Python workers get; all operators share the one value."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder of spark.checkpoint.dir.

    Where it is unset, a local folder serves a local master, as in tests; a cluster has no folder that all its
    machines see then, so that is an error. The folders hold intermediate tables and can go when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        base = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and read them back."""
    path = f"{shared_dir(spark)}/t"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
