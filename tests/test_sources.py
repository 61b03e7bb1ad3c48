"""Readers and writers."""

import pytest

from brook import run
from brook.sources import bucketed, read, register, tables_in, write


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.range(20).selectExpr("id", "id % 3 as k", "concat('n', id) as name")
    options = {"header": True} if kind == "csv" else {}
    write(df, str(tmp_path / f"t.{kind}"), kind, **options)
    back = read(spark, str(tmp_path / f"t.{kind}"), kind, **(options | ({"inferSchema": True} if kind == "csv" else {})))
    assert sorted(map(tuple, back.select("id", "k", "name").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception):
        write(df, str(tmp_path / f"t.{kind}"), kind)


def test_partitions_are_pruned(spark, tmp_path):
    write(spark.range(30).selectExpr("id", "id % 3 as k"), str(tmp_path / "t.parquet"), partition_by=["k"])
    df = run(spark, "from t where k = 1 select id", tables_in(spark, str(tmp_path), ["t"]))
    assert df.count() == 10 and "PartitionFilters: [isnotnull(k" in df._jdf.queryExecution().toString()


def test_buckets_need_no_shuffle(spark, tmp_path):
    for name in ("brook_b1", "brook_b2"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        bucketed(spark.range(100).selectExpr("id", "id % 7 as k"), name, 4, "k", path=str(tmp_path / name))
    try:
        plan = run(spark, "from brook_b1 group by k (# as n)")._jdf.queryExecution().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        for name in ("brook_b1", "brook_b2"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_views_and_functions_of_the_session(spark):
    register({"brook_v": spark.range(3)})
    spark.udf.register("brook_twice", lambda x: x * 2, "long")
    try:
        assert [r[0] for r in run(spark, "from brook_v select brook_twice(id) as t order by t").collect()] == [0, 2, 4]
    finally:
        spark.catalog.dropTempView("brook_v")
