"""Sinks: row CSV, records JSON, JSON by key, and wide metrics as long rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_rows(df: DataFrame, digits: int = 6) -> DataFrame:
    """Text columns for CSV: doubles with a fixed number of digits, lists joined by |, maps as JSON."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, (T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flat_rows(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def by_key(df: DataFrame, *keys: str, most: int = 1000, digits: int = 6) -> DataFrame:
    """(key, part, n, records): the records of each key (keys joined by |) in order of their values, as JSON lists of at most `most` records.

    Rows are dealt by ranges of key and values and sorted within, and each task writes lists as its rows go by, so a key with a third
    of all rows is many lists in many tasks, in the order of part. Nothing is gathered by key. Doubles are rounded, nulls left out.
    """
    rest = [f for f in df.schema if f.name not in keys]
    plain = [F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in rest]
    rows = df.select(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)).alias("key"), F.struct(*plain).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, key, held = TaskContext.get().partitionId() << 40, 0, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first + made]), pa.array([len(held)]), pa.array(["[" + ",".join(held) + "]"])], ["key", "part", "n", "records"])

        for b in batches:
            for k, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (k != key or len(held) == most):
                    yield out()
                    made, held = made + 1, []
                key = k
                held.append(record)
        if held:
            yield out()

    order = ["key", "record"] if rest else ["key"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("key", F.to_json("record").alias("record")).mapInArrow(run, "key string, part long, n long, records string")


def write_by_key(df: DataFrame, path: str, *keys: str, most: int = 1000) -> None:
    """by_key as lines of JSON, {"key": ..., "part": ..., "records": [...]}; files and lines are in order of key and part."""
    key = F.to_json(F.struct("key"))
    line = F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit(',"part":'), F.col("part").cast("string"), F.lit(',"records":'), F.col("records"), F.lit("}"))
    by_key(df, *keys, most=most).select(line.alias("value")).write.mode("overwrite").text(path)


def long_metrics(df: DataFrame, section: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide metrics as (keys, section, metric, value)."""
    return df.select(*keys, *(F.col(m).cast("double") for m in metrics)).unpivot(keys, metrics, "metric", "value").withColumn("section", F.lit(section))
