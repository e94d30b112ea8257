"""The `patient` and `daily` tables as views over the test tables (layout in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import read_table


# Layout of the test tables; stated, so that no file footer is read to plan a query.
ORDERS = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
          "o_orderdate timestamp_ntz, o_orderpriority string")
CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
LINEITEM = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
            "l_shipdate timestamp_ntz")
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"


def _long(col):
    return F.floor(col).cast("bigint")


def patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: subject covariates, survival, discharge and ventilation days."""
    orders = read_table(spark, f"{sf_dir}/orders.parquet", ORDERS)
    customer = read_table(spark, f"{sf_dir}/customer.parquet", CUSTOMER).select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    k = _long(F.col("o_totalprice"))
    died = (k % 4) == 0
    # least() and coalesce() skip the null death day of survivors, so each input is named once
    death_day = F.when(died, 1 + _long(k / 4) % 60)
    leave_day = 2 + _long(k / 5) % 59
    # one-row inline: predicates on the derived days stay above it instead of being expanded into the scan
    days = orders.select("*", F.inline(F.array(F.struct(
        F.when(died, 1).otherwise(0).alias("PatientDied"),
        F.when(died, 0).otherwise(1).alias("PatientDischarged"),
        F.coalesce(death_day, F.lit(61).cast("bigint")).alias("Surv0To60"),
        F.when(~died, leave_day).alias("Disc0To60"),
        F.least((F.col("o_orderkey") * 7 + F.col("o_custkey") * 3) % 66, death_day).alias("DaysMechVent"),
        F.coalesce(death_day, leave_day).alias("event")))))
    return days.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("CombinedID"),
        F.col("c_nationkey").alias("CombinedicuID"),
        F.lit(1).alias("icuByDummy"),
        F.year("o_orderdate").cast("string").alias("Year"),
        F.col("o_orderpriority").alias("DiagID2"),
        F.when(F.col("o_orderstatus") == "F", "Medical")
         .when(F.col("o_orderstatus") == "O", "Surgical/Elective")
         .otherwise("Surgical/Emeregency").alias("AdmCatID"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Male")
         .otherwise("Female").alias("Gender"),
        (k % 41).alias("ApacheIIScore"),
        (18 + _long(k / 7) % 73).alias("Age"),
        ((150 + _long(k / 3) % 300).cast("double") / 10).alias("BMI"),
        (F.col("o_orderkey") % 4).alias("inMV2_4"),
        (_long(F.col("o_orderkey") / 4) % 4).alias("Propofol2_4"),
        (_long(F.col("o_orderkey") / 16) % 4).alias("OralIntake2_4"),
        (_long(F.col("o_orderkey") / 64) % 4).alias("PN2_4"),
        (F.col("o_custkey") % 4).alias("EN2_4"),
        "PatientDied", "PatientDischarged", "Surv0To60", "Disc0To60", "DaysMechVent", "event")


def unit_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in intensive care per subject, before they are bounded by the follow-up."""
    orders = read_table(spark, f"{sf_dir}/orders.parquet", ORDERS)
    return orders.select(F.col("o_orderkey").alias("CombinedID"),
                         ((F.col("o_orderkey") * 5 + F.col("o_custkey")) % 80).alias("unit_days"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per diary day: the line items of each order, numbered in a fixed order."""
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    days = line_items(spark, sf_dir).withColumn("Study_Day", F.row_number().over(w))
    zero = (F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10)
    intake = F.when(zero, F.lit(0.0)).otherwise(F.col("l_quantity"))
    out = days.select(
        F.col("l_orderkey").alias("CombinedID"),
        "Study_Day",
        (F.col("l_linenumber") == 7).alias("incomplete_day"),
        (F.col("l_partkey") % 2).alias("EN"),
        F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0).alias("PN"),
        (F.col("l_linenumber") % 2).alias("OralIntake"),
        (intake / 32).alias("proteinGproKG"),
        (F.col("l_quantity") / 2).alias("calproKg"),
        (intake * 2).alias("proteinAdjustedPercentage"),
    )
    g = F.col("proteinGproKG")
    return out.withColumns({
        "proteinCat2": F.when((g >= 0.8) & (g <= 1.2), 1).otherwise(0),
        "proteinCat3": F.when(g > 1.2, 1).otherwise(0),
    })


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/lineitem.parquet", LINEITEM)


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the `embeddings` table as given coefficient draws: ``sim_id, beta``."""
    return read_table(spark, f"{sf_dir}/embeddings.parquet", EMBEDDINGS).select(
        F.col("vec_id").alias("sim_id"),
        F.col("embedding").cast("array<double>").alias("beta"))
