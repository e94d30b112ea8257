"""Sources and sinks: parquet tables, CSV reports, literal tables, checkpoints."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BOM = "﻿"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a parquet table; with a schema, no file footer is read for inference."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Write an intermediate table as parquet with one file per partition."""
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a table bucketed and sorted by subject, so later joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def bucketed_copy(df: DataFrame, key: str, buckets: int, folder: str | None = None) -> DataFrame:
    """``df`` written in ``buckets`` files' worth of buckets by ``key``, sorted in each, and read back as that table.

    Tables of equal keys and buckets join and group by the key without a shuffle. Rows are dealt by the key first, so that
    a bucket is one file. The data lies below ``folder`` (default: the checkpoint folder), only its name in the catalog.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{folder or checkpoint_folder(spark)}/{name}"
    dealt = df.repartition(buckets, key)
    dealt.write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def write_csv(df: DataFrame, path: str, *, single_file: bool = False, excel: bool = False) -> None:
    """Write a result table as CSV with a header.

    ``single_file`` is meant for report tables whose row count is fixed by the number of intervals
    or strata. ``excel`` puts a UTF-8 byte order mark before the header.
    """
    out = df.coalesce(1) if single_file else df
    if excel:
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_csv_per_group(df: DataFrame, path: str, key: str = "comparison", *, excel: bool = False) -> None:
    """Write one CSV folder per value of ``key`` in a single job; ``excel`` as in ``write_csv``."""
    if excel:
        first = next(c for c in df.columns if c != key)
        df = df.withColumnRenamed(first, BOM + first)
    df.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table given in the program."""
    return spark.createDataFrame(rows, schema)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints named by the session.

    Only a local-mode session may fall back to a folder of its own; elsewhere an executor could
    not reach it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="pamspark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table under the checkpoint folder, in folders ``by``, and continue from the written copy.

    A written table is computed once and survives lost executors; an RDD checkpoint would compute its
    input a second time.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run in tasks."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="pamspark-code-")
    sc.addPyFile(shutil.make_archive(f"{folder}/pamspark", "zip", package.parent, package.name))
    _shipped.add(sc.applicationId)
