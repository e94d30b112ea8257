"""Training-data pipeline over the documents table: stages that are each written as Parquet and read again.

Every stage takes what the stage before it has kept; all but the last return the columns of documents. Null texts are
empty texts, rows that are repeated count as often as they stand until the near-duplicate stage keeps one of them, an
empty table passes through every stage. Columns beside those of documents travel in one struct, so that no name of theirs
can clash with one that an operator uses; only `shard` and `slot` are replaced by the last stage's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pamspark.llm import decontaminate, mixing, neardup, quality, sharding
from pamspark.llm.common import bounded_batches, written
from pamspark.sources.io import ship_package


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
EXTRA = "extra_columns"


def _plain(docs: DataFrame) -> DataFrame:
    """docs with the columns of documents, and all others as fields of EXTRA."""
    others = [c for c in docs.columns if c not in COLUMNS]
    fields = [F.struct(*[F.col(f"`{c}`") for c in others]).alias(EXTRA)] if others else []
    return docs.select(*[c for c in docs.columns if c in COLUMNS], *fields)


def _own(out: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """The columns of docs again, from a table with those of `_plain`, and more of its columns."""
    own = [F.col(c) if c in COLUMNS else F.col(EXTRA).getField(c).alias(c) for c in docs.columns if c not in more]
    return out.select(*own, *more)


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware classifier keeps."""
    ship_package(spark)
    bounded_batches(spark)
    plain = _plain(docs)
    model = quality.fit(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _own(quality.judge(plain, model).filter("keep"), docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least id."""
    ship_package(spark)
    bounded_batches(spark)
    plain = _plain(docs)
    return _own(neardup.first_of_each(plain, neardup.classes(plain)), docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    ship_package(spark)
    bounded_batches(spark)
    return _own(decontaminate.without_leaks(_plain(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them; each source's last one is cut at the budget."""
    sized = _plain(docs).withColumn("_size", mixing.word_count(F.col("text")))
    mixed = mixing.mixed_texts(mixing.mix(sized, size="_size", keys=["doc_id", "text"]), size="_size")
    return _own(mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def _sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard of 16 and their place in it."""
    return _own(sharding.place(_plain(docs), ["doc_id", "text"]), docs, "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("mixing", _mixing),
    ("sharding", _sharding),
]

#: No stage can be told in SQL (trained models, sampled hashes, rings), so the test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
