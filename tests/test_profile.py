import math

import pytest
from maskwright.config import Settings
from maskwright.functions import scalars
from maskwright.operators import profile
from pyspark.sql import functions as F


def test_profile_counts_null_as_one_value(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "c string")
    row = profile.profile(df).first()
    assert (row["n_values"], row["n_nulls"], row["n_distinct"], row["unique_entries"]) == (3, 2, 3, 1)
    assert row["cardinality"] == pytest.approx(1.0)
    assert row["coverage_of_uniques"] == pytest.approx(1 / 3)
    p = [2 / 3, 1 / 3]
    assert row["entropy"] == pytest.approx(-sum(x * math.log(x) for x in p), abs=1e-6)


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    rows = {r["colname"]: r for r in profile.profile(df).collect()}
    assert rows["b"]["cardinality"] is None and rows["b"]["entropy"] == 0.0
    assert profile.drop_empty_columns(df).columns == ["a"]
    assert profile.profile(df.limit(0)).count() == 0


def test_coverage_boundary_is_strict(spark):
    exactly = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 6, 7, 8, 9, 9][:8] + [9, 9]], "c int")  # 8 of 10 unique
    above = spark.createDataFrame([(x,) for x in range(9)], "c int")
    assert profile.first_class_identifiers(profile.profile(exactly)).count() == 0
    assert profile.first_class_identifiers(profile.profile(above)).count() == 1
    assert profile.first_class_identifiers(profile.profile(exactly), Settings(identifier_cardinality=30.0)).count() == 1


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "`a.b` int, `c d` int")
    assert {r["colname"]: r["n_distinct"] for r in profile.profile(df).collect()} == {"a.b": 1, "c d": 2}
    assert profile.prefix(df, 1).columns == ["a.b"]


def test_numeric_text(spark):
    df = spark.createDataFrame([("34",), ("34.0",), ("-1",), ("",), (None,), ("٣",)], "v string")
    rows = df.select(scalars.is_digits(F.col("v")).alias("d"), scalars.numeric(F.col("v")).alias("n"), scalars.numeric_or_zero(F.col("v")).alias("z")).collect()
    assert [r["d"] for r in rows] == [True, False, False, False, None, False]
    assert [r["n"] for r in rows] == [34.0, 34.0, -1.0, None, None, None]
    assert [r["z"] for r in rows] == [34.0, 0, 0, 0, 0, 0]
    assert scalars.combinations_count(10, 3) == 120 and scalars.combinations_count(4) == 11


def test_orders_of_columns_and_identifiers(spark):
    df = spark.createDataFrame([(i, i % 4, i % 2, None) for i in range(20)], "id int, four int, two int, nothing string")
    profiled = profile.profile(df)
    assert [r["colname"] for r in profile.ranked(profiled).orderBy("place").collect()] == ["id", "four", "two", "nothing"]
    assert [r["colname"] for r in profile.ranked(profiled, "entropy").orderBy("place").collect()] == ["id", "four", "two", "nothing"]
    assert profile.highest_cardinality(profiled, ["two", "four"]).first()["colname"] == "four"
    assert profile.without_identifiers(df).columns == ["four", "two", "nothing"]
    assert profile.prefix(df, 0).columns == df.columns
