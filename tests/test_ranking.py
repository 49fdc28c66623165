import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.operators import ranking, screening
from tests.conftest import rows


def skewed(spark, n=3000):
    """One group holds most rows, one value a third of them; a group of one; NULLs; ties."""
    rng = random.Random(7)
    data = []
    for i in range(n):
        group = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        value = 5.0 if rng.random() < 0.33 else float(rng.randrange(40))
        data.append((i, group, None if rng.random() < 0.02 else value))
    data.append((n, "single", 1.0))
    return spark.createDataFrame(data, "id int, g string, v double")


def test_average_rank_equals_window(spark):
    df = skewed(spark)
    ties = Window.partitionBy("g", "v")
    plain = df.where("v is not null").select(
        "id", (F.rank().over(Window.partitionBy("g").orderBy("v")) + (F.count(F.lit(1)).over(ties) - 1) / 2).alias("r")
    )
    got = ranking.average_rank(df, ["g"], "v", "r")
    assert rows(got.where("v is not null"), "id", "r") == rows(plain, "id", "r")
    assert got.where("v is null and r is not null").count() == 0
    assert got.count() == df.count()


def test_percent_rank_equals_window(spark):
    df = skewed(spark)
    known = df.where("v is not null and g <> 'single'")
    up = F.percent_rank().over(Window.partitionBy("g").orderBy("v"))
    down = F.percent_rank().over(Window.partitionBy("g").orderBy(F.desc("v")))
    got = ranking.percent_rank(df, ["g"], {"p": ("v", False), "q": ("v", True)})
    assert rows(got.where("v is not null and g <> 'single'"), "id", "p", "q") == rows(
        known.select("id", up.alias("p"), down.alias("q")))
    assert rows(got.where("g = 'single'"), "p", "q") == [(None, None)]


def test_positions_equal_row_number(spark):
    df = skewed(spark)
    w = Window.partitionBy("g").orderBy(F.desc_nulls_last("v"), "id")
    plain = df.select("id", F.row_number().over(w).cast("bigint").alias("p"),
                      F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"))
    for slices in (1, 7):
        got = ranking.positions(df, ["g"], [ranking.Descending("v"), "id"], "p", "n", slices)
        assert rows(got, "id", "p", "n") == rows(plain)


def test_positions_split_equal_rows(spark):
    """A third of all rows is one and the same row; they still get every place once and no slice holds them all."""
    data = [("g", 5.0)] * 1000 + [("g", float(i)) for i in range(1000)] + [("h", float(i)) for i in range(1000)]
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    got = ranking.positions(df, ["g"], ["v"], "p", "n", 8)
    places = sorted(r["p"] for r in got.where("g = 'g'").collect())
    assert places == list(range(1, 2001))
    assert sorted(r["p"] for r in got.where("g = 'g' and v = 5").collect()) == list(range(6, 1007))
    assert got.where("g = 'g' and p <= 5").agg(F.max("v")).first()[0] == 4.0
    named = df.withColumn("r", F.monotonically_increasing_id())
    parts = ranking._sliced(named, [F.col("g"), F.col("v"), F.col("r")], 8).where("v = 5").groupBy("__slice").count()
    assert parts.count() > 1


def test_lowest_with_ties_is_numeric(spark):
    df = spark.createDataFrame([("c", 2.0, 1), ("c", 10.0, 2), ("c", 2.0, 3), ("d", None, 4)], "c string, p double, i int")
    assert rows(ranking.lowest_with_ties(df, ["c"], "p"), "i") == [(1,), (3,)]


def test_clusters_at_borders(spark):
    df = spark.createDataFrame([(0.2,), (0.25,), (0.7499,), (0.75,), (1.0,), (None,)], "x double")
    got = [r[0] for r in df.select(ranking.share_class(F.col("x"), fixed.CLUSTERS)).collect()]
    assert got == ["higher", "intermediate", "intermediate", "lower", "lower", None]


def test_potency_rank_ties_and_group_of_one(spark):
    df = spark.createDataFrame(
        [("E", "1", 3.0, 1.0), ("E", "2", 2.0, 2.0), ("E", "3", 2.0, 2.0), ("E", "4", 1.0, 9.0), ("P", "9", 1.0, 1.0)],
        "hormone string, CASN string, MFC double, LEC double",
    )
    got = rows(screening.potency_rank(df), "hormone", "CASN", "rank", "rank_percent", "cluster")
    assert got == [
        ("E", "1", 1, 0.25, "intermediate"), ("E", "2", 2, 0.5, "intermediate"), ("E", "3", 3, 0.75, "lower"),
        ("E", "4", 4, 1.0, "lower"), ("P", "9", 1, 1.0, "lower"),
    ]
