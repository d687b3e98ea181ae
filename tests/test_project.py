import random
import statistics
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weirworks.operators import medians, project
from weirworks.operators.project import FieldMap, keep
from weirworks.types import schema_of, spark_type


def test_mapping_keeps_listed_columns_and_nulls_bad_casts(spark):
    df = spark.createDataFrame([("1", "x", "2.5"), ("no", "y", None)], "a string, b string, c string")
    out = project.apply_mapping(df, [keep("a", "int", "id"), keep("c", "double", "money.net"), FieldMap("b", dropped=True)])
    assert out.columns == ["id", "money"]
    assert rows(out.select("id", "money.net")) == [(1, 2.5), (None, None)]


def test_mapping_reads_nested_paths_and_names_with_dots(spark):
    df = spark.sql("SELECT named_struct('x', 7) AS s, 8 AS `s.x`, 9 AS `odd name`")
    out = project.apply_mapping(df, [keep("s.x", "long", "dotted"), keep("odd name", "string")])
    assert rows(out) == [(8, "9")]


def test_select_drop_and_rename_nested(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', 2, 'b', named_struct('c', 3, 'd', 4)) AS s")
    assert project.drop_fields(df, ["s.b.c", "id", "unknown"]).schema.simpleString() == "struct<s:struct<a:int,b:struct<d:int>>>"
    assert project.rename_field(df, "s.a", "s.z").select("s.*").columns == ["b", "z"]
    assert rows(project.rename_field(df, "s.a", "top").select("top", "s.b.c")) == [(2, 3)]
    assert project.rename_field(df, "id", "key.part").select("key.part").first()[0] == 1
    assert project.select_fields(df, ["s.b.d"]).first()[0] == 4


def test_snake_case_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["orderId", "Total Price (EUR)", "_x9Y_"])
    assert project.snake_case(df).columns == ["order_id", "total_price_eur", "x9_y"]


def test_null_fields_by_option(spark):
    df = spark.createDataFrame([(1, "", None, -1, "null"), (2, None, None, -1, None)], "id int, e string, n double, m int, t string")
    assert project.drop_null_fields(df).columns == ["id", "e", "m", "t"]
    assert project.drop_null_fields(df, empty_string=True, null_string=True, minus_one=True).columns == ["id"]
    assert project.drop_null_fields(df, custom=[(-1, "int")]).columns == ["id", "e", "t"]


def test_fill_missing(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, None), ("b", 5.0, "y"), (None, 7.0, "q"), (None, None, "q"), ("b", 7.0, None)], "g string, v double, w string")
    assert rows(project.fill_missing(df, "v", by=["g"]).select("g", "v")) == [("a", 1.0), ("a", 1.0), ("b", 5.0), ("b", 7.0), (None, 7.0), (None, 7.0)]
    assert [r.f for r in project.fill_missing(df, "w", filled="f").where("w IS NULL").collect()] == ["q", "q"]
    assert sorted(r.v for r in project.fill_missing(df, "v", method="median").collect())[1] == 5.0
    with pytest.raises(ValueError):
        project.fill_missing(df, "w", method="mean")


def test_flatten_and_choice(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', named_struct('b', 2)) AS s, array(named_struct('k', 'x'), named_struct('k', 'y')) AS l")
    assert project.flatten(df).columns == ["id", "s_a_b", "l"]
    assert rows(project.flatten(df, arrays=True)) == [(1, 2, "x"), (1, 2, "y")]
    mixed = spark.createDataFrame([("7",), ("x",), ("2.5",), (None,)], "c string")
    made = project.resolve_choice(mixed, "c", make_columns=["int", "double", "string"])
    assert rows(made) == [(7, None, None), (None, 2.5, None), (None, None, "x"), (None, None, None)]
    assert rows(project.resolve_choice(mixed, "c", cast="long")) == [(7,), (None,), (None,), (None,)]


def test_types():
    assert spark_type("decimal").simpleString() == "decimal(38,18)"
    assert spark_type("array<struct<a:int>>").simpleString() == "array<struct<a:int>>"
    assert schema_of([("a", "long"), ("b", "map<string,string>")]).simpleString() == "struct<a:bigint,b:map<string,string>>"
    with pytest.raises(ValueError):
        spark_type("choice")


def test_drift_and_identifier(spark):
    df = spark.range(5).withColumn("x", F.lit("v"))
    drift = project.schema_drift(df, schema_of([("id", "int"), ("gone", "string")]))
    assert rows(drift) == [("gone", "missing", "string", None, 0), ("id", "type", "int", "bigint", 5), ("x", "extra", None, "string", 5)]
    assert rows(project.schema_drift(df, df.schema)) == []
    assert project.add_identifier(df).select("id").distinct().count() == 5
    assert project.add_uuid(df).select("uuid").distinct().count() == 5


def test_exact_median_of_very_many_values(spark):
    """1,000,001 distinct values in one group; the sketch is another method."""
    df = spark.range(1_000_001).select((F.col("id") * 500_000).alias("v"))
    assert medians.medians(df, "v").first().median == 250_000_000_000.0
    filled = project.fill_missing(df.unionByName(spark.createDataFrame([(None,)], "v bigint")), "v", method="median")
    assert filled.where("v = 250000000000").count() == 2


def test_medians_by_selection(spark, monkeypatch):
    """Groups of all shapes, with the limit so low that all but the smallest are narrowed."""
    luck = random.Random(4)
    shapes = {
        None: [7.5],
        "same": [3.0] * 900,
        "two": [1.0] * 400 + [2.0] * 400,
        "split": [0.0] * 300 + [float(n) for n in range(1, 51)] + [1e6] * 350,
        "ends": [0.0] * 500 + [1e6] * 499 + [5.0],
        "odd": [luck.random() for _ in range(777)],
        "powers": [2.0**n for n in range(-500, 500)],
        "few": [1.0, 4.0],
        "nan": [float("nan"), 1.0, float("nan"), 2.0],
        "none": [None, None],
    }
    data = [(g, v) for g, vs in shapes.items() for v in vs] + [("split", None)]
    luck.shuffle(data)
    df = spark.createDataFrame(data, "g string, v double")
    usual = rows(medians.medians(df, "v", ["g"]))
    want = sorted(((g, statistics.median([v for v in vs if v == v])) for g, vs in shapes.items() if g != "none"), key=repr)
    assert usual == want
    monkeypatch.setattr(medians, "MOST", 20)
    monkeypatch.setattr(medians, "CELLS", 32)
    assert rows(medians.medians(df, "v", ["g"])) == want
    whole = df.select(F.col("g").alias("a.b"), F.col("v").cast("decimal(38,3)").alias("x.y")).where("`a.b` IN ('two', 'few')")
    assert rows(medians.medians(whole, "x.y", ["a.b"])) == [("few", Decimal("2.5")), ("two", Decimal("1.5"))]
    assert medians.medians(df.limit(0), "v").count() == 0 == medians.medians(df.limit(0), "v", ["g"]).count()
