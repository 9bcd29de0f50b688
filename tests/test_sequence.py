"""Gapless numbers: the same for any partitioning, going on after an earlier batch."""

import pytest
from pyspark.sql import functions as F

from apertura.operators.sequence import load_order, numbered, numbered_within, unique_names


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbers_follow_the_order_without_gaps(spark, parts):
    df = spark.range(500).select(((F.col("id") * 7919) % 501).alias("k"), F.lit("x").alias("n")).repartition(parts)
    got = {r.k: r.n for r in numbered(df, F.col("k").desc(), name="n").collect()}
    assert got == {k: n for n, k in enumerate(sorted(got, reverse=True), 1)}


def test_rows_that_the_order_does_not_tell_apart_and_nulls(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(1,)] * 40 + [(0,)], "k int")
    got = numbered(df, F.col("k").asc_nulls_last()).collect()
    assert sorted(r.seq for r in got) == list(range(1, 45))
    assert {r.seq for r in got if r.k is None} == {42, 43, 44}
    assert [r.seq for r in got if r.k == 0] == [1]


def test_a_second_batch_goes_on(spark):
    first = load_order(spark.range(10).toDF("k"), F.col("k"))
    second = load_order(spark.range(5).toDF("k").repartition(3), F.col("k"), loaded=first)
    assert [r.load_seq for r in second.orderBy("k").collect()] == [11, 12, 13, 14, 15]
    assert load_order(spark.range(0).toDF("k"), F.col("k"), loaded=first).count() == 0
    assert load_order(spark.range(2).toDF("k"), F.col("k"), loaded=first.limit(0)).agg(F.min("load_seq")).first()[0] == 1


def test_numbers_within_groups_of_any_size(spark):
    rows = [("hot", k) for k in range(600)] + [(None, k) for k in range(5)] + [(f"g{k % 9}", k) for k in range(90)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = numbered_within(df, "g", F.col("k")).collect()
    assert {(r.g, r.k): r.nth for r in got} == {(g, k): 1 + sum(h == g and j < k for h, j in rows) for g, k in rows}


def test_names_that_look_numbered_meet_no_other(spark):
    names = ["a.jpg", "a.jpg", "a.jpg", "a (2).jpg", "a (2).jpg", "a (2) (1).jpg", "b", "b", "b (2)", "", "", None, "x.tar.gz", "x.tar.gz"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    got = {r.k: r.unique_name for r in unique_names(df, "n", F.col("k")).collect()}
    given = [n for n in got.values() if n is not None]
    assert len(given) == len(set(given)) == len(names) - 1
    assert (got[0], got[1], got[2], got[11]) == ("a.jpg", "a (2).jpg", "a (3).jpg", None)
    assert got[13] == "x.tar (2).gz"
