"""Declared table layouts. Operators fail on a missing column before any job starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PATIENT = T.StructType([
    T.StructField("CombinedID", T.LongType(), False),
    T.StructField("CombinedicuID", T.IntegerType(), False),
    T.StructField("icuByDummy", T.IntegerType(), False),
    T.StructField("Year", T.StringType()),
    T.StructField("DiagID2", T.StringType()),
    T.StructField("AdmCatID", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("ApacheIIScore", T.LongType()),
    T.StructField("Age", T.LongType()),
    T.StructField("BMI", T.DoubleType()),
    T.StructField("inMV2_4", T.LongType()),
    T.StructField("Propofol2_4", T.LongType()),
    T.StructField("OralIntake2_4", T.LongType()),
    T.StructField("PN2_4", T.LongType()),
    T.StructField("EN2_4", T.LongType()),
    T.StructField("PatientDied", T.IntegerType()),
    T.StructField("PatientDischarged", T.IntegerType()),
    T.StructField("Surv0To60", T.LongType()),
    T.StructField("Disc0To60", T.LongType()),
    T.StructField("DaysMechVent", T.LongType()),
    T.StructField("event", T.LongType()),
])

DAILY = T.StructType([
    T.StructField("CombinedID", T.LongType(), False),
    T.StructField("Study_Day", T.IntegerType(), False),
    T.StructField("incomplete_day", T.BooleanType()),
    T.StructField("EN", T.LongType()),
    T.StructField("PN", T.IntegerType()),
    T.StructField("OralIntake", T.IntegerType()),
    T.StructField("proteinGproKG", T.DoubleType()),
    T.StructField("calproKg", T.DoubleType()),
    T.StructField("proteinAdjustedPercentage", T.DoubleType()),
    T.StructField("proteinCat2", T.IntegerType()),
    T.StructField("proteinCat3", T.IntegerType()),
])


def require_columns(df: DataFrame, names, what: str = "table") -> DataFrame:
    """Return ``df`` unchanged, or raise naming the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {', '.join(missing)}")
    return df


def require_schema(df: DataFrame, schema: T.StructType, what: str = "table") -> DataFrame:
    """As ``require_columns``, and the column types must match as well."""
    require_columns(df, schema.fieldNames(), what)
    wrong = [
        f"{f.name}: {df.schema[f.name].dataType.simpleString()}, want {f.dataType.simpleString()}"
        for f in schema.fields if df.schema[f.name].dataType != f.dataType
    ]
    if wrong:
        raise ValueError(f"{what} has wrong type(s): {'; '.join(wrong)}")
    return df
