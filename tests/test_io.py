import pytest

from pamspark.sources import io


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, [3.0])], "k int, s string, v array<double>")
    io.write_table(df, f"{tmp_path}/t")
    back = io.read_table(spark, f"{tmp_path}/t", df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, io.cut_lineage(df).collect())) == sorted(map(tuple, df.collect()))


def test_csv_with_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    io.write_csv(df, f"{tmp_path}/c", single_file=True, excel=True)
    text = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfa,b") and text.count(b"\n") == 2


def test_csv_per_group(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3)], "comparison string, v int")
    io.write_csv_per_group(df, f"{tmp_path}/g")
    assert {p.name for p in (tmp_path / "g").glob("comparison=*")} == {"comparison=A", "comparison=B"}
    io.write_csv_per_group(df, f"{tmp_path}/x", excel=True)
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfv\n") for p in (tmp_path / "x").glob("comparison=*/*.csv"))


def test_bucketed_table_joins_without_a_shuffle(spark):
    df = spark.range(1000).withColumnRenamed("id", "CombinedID")
    io.write_bucketed(df, "bucketed_subjects", "CombinedID", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = spark.table("bucketed_subjects")
        plan = t.join(t.withColumnRenamed("CombinedID", "k"), t["CombinedID"] == F_col("k"))
        assert plan.count() == 1000
        assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_subjects")


def test_subjects_windows_and_rows_meet_without_a_shuffle(inputs, spark):
    """Only the sums by admission category are exchanged."""
    from pamspark.plans import queries
    subjects, windows = queries._bucketed_subjects(inputs, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = queries._co_partitioned(inputs)
        rows = out.count()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == 3 and "SortMergeJoin" in plan
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("AdmCatID" in line and "CombinedID" not in line for line in exchanges)
    assert subjects.count() == inputs.fitted.count() and windows.count() == inputs.diary_ids.count()


def F_col(name):
    from pyspark.sql import functions as F
    return F.col(name)


def test_checkpoint_folder_is_the_sessions(spark):
    assert io.checkpoint_folder(spark) == spark.conf.get("spark.checkpoint.dir")



def test_literal_table(spark):
    assert io.literal_table(spark, [("a", 1)], "c string, n int").first().n == 1


def test_entry_and_registry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 56
    assert set(entry.oracle_sql()) <= set(entry.queries())
