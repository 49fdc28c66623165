import pytest
from pyspark.sql import functions as F

from dosescreen.operators import aggregates, joins, quality, reshape
from dosescreen.operators.quality import Audit
from tests.conftest import rows


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, AUC_a int, b int, auc_c int")
    assert reshape.column_range(df, "AUC_a", "auc_c") == ["AUC_a", "b", "auc_c"]
    assert reshape.columns_containing(df, "auc") == ["AUC_a", "auc_c"]
    assert reshape.columns_containing(df, "auc", ignore_case=False) == ["auc_c"]
    assert reshape.to_front(df, ["b"]).columns == ["b", "id", "AUC_a", "auc_c"]


def test_unpivot_keeps_nulls_and_dotted_names(spark):
    df = spark.createDataFrame([(1, "x", None)], "id int, `Cons.` string, `Ind.` string")
    assert rows(reshape.unpivot(df, ["id"], ["Cons.", "Ind."], "k", "v")) == [(1, "Cons.", "x"), (1, "Ind.", None)]


def test_unpivot_groups_drops_empty(spark):
    df = spark.createDataFrame([(1, 2.0, None, 3.0, None), (2, None, None, None, None)],
                               "id int, LEC_E double, LEC_P double, MFC_E double, MFC_P double")
    assert rows(reshape.unpivot_groups(df, ["E", "P"], ["LEC", "MFC"], "h")) == [(1, "E", 2.0, 3.0)]
    assert reshape.unpivot_groups(df, ["E", "P"], ["LEC", "MFC"], "h", drop_empty=False).count() == 4


def test_unpivot_groups_missing_column(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "id int, LEC_E double, hits_P string")
    assert rows(reshape.unpivot_groups(df, ["E", "P"], ["LEC", "hits"], "h")) == [(1, "E", 2.0, None), (1, "P", None, "a")]


def test_widen(spark):
    df = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 3, 4), (2, "c", 5, 6)], "k int, n string, v int, w int")
    assert rows(reshape.widen(df, ["k"], "n", ["a", "b"], ["v", "w"])) == [(1, 1, 3, 2, 4), (2, None, None, None, None)]


def test_split_columns_short_and_surplus(spark):
    df = spark.createDataFrame([("a_b_c_d",), ("a",), (None,)], "s string")
    out = reshape.split_columns(df, "s", ["x", "y"], "_", remove=True)
    assert rows(out) == [("a", "b"), ("a", None), (None, None)]


def test_explode_slots_always_six(spark):
    df = spark.createDataFrame([("p", "c(1, 1)"), ("q", "c(NA, 1, 1, 1, 1, 1)"), ("r", None)], "id string, v string")
    out = reshape.explode_slots(df, "v", 6, "dose", "hit")
    assert out.count() == 18
    assert rows(out.where("id = 'p'")) == [("p", k, 1.0 if k < 3 else None) for k in range(1, 7)]
    assert rows(out.where("id = 'q' and hit is null")) == [("q", 1, None)]


def test_join_null_keys_and_suffixes(spark):
    a = spark.createDataFrame([("k", 1), (None, 2)], "id string, v int")
    b = spark.createDataFrame([("k", 10), (None, 20)], "key string, v int")
    assert rows(joins.join_on(a, b, {"id": "key"}), "id", "v.x", "v.y") == [("k", 1, 10), (None, 2, None)]
    assert rows(joins.join_on(a, b, {"id": "key"}, null_keys_match=True), "v.x", "v.y") == [(1, 10), (2, 20)]


def test_right_join_keeps_universe(spark):
    a = spark.createDataFrame([("k", 1), ("z", 3)], "id string, v int")
    b = spark.createDataFrame([("k",), ("m",)], "casn string")
    assert rows(joins.join_on(a, b, {"id": "casn"}, "right")) == [("k", 1), ("m", None)]


def test_membership(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    one = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    two = spark.createDataFrame([("b",)], "y string")
    assert rows(joins.member_of(df, "id", one, "x")) == [("a",)]
    assert rows(joins.not_member_of(df, "id", one, "x")) == [("b",), (None,)]
    assert rows(joins.with_membership(df, "id", {"s": (one, "x"), "t": (two, "y")})) == [
        ("a", True, False), ("b", False, True), (None, False, False)]


def test_collapse(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("m", None)], "k string, v string")
    assert rows(aggregates.collapse_all(df, ["k"], "v", "o")) == [("k", "a, b, b")]
    assert rows(aggregates.collapse_distinct(df, ["k"], "v", "o")) == [("k", "a, b"), ("m", "")]


def test_quality_reports(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", None)], "k string, v string")
    right = spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    assert rows(quality.key_unique(df, ["k"])) == [(3, 2, False)]
    assert rows(quality.key_duplicates(df, ["k"])) == [("a", 2)]
    assert rows(quality.join_fanout(df, right, "k", "k")) == [(3, 5)]
    assert rows(quality.null_count(df, ["k", "v"])) == [(0, 1)]
    assert rows(quality.unmatched_keys(df, "k", right, "k")) == [("b",)]
    assert rows(quality.unexpected_nulls(df, "v", "k", right, "k")) == [("b",)]
    assert rows(quality.parse_failures(df, {"v": "double"})) == [("v", 2, 1)]
    assert rows(quality.rule_gaps(df.replace("x", "FIX"), ["v"])) == [("v", 1)]
    with pytest.raises(ValueError):
        quality.require_unique(df, ["k"])
    assert quality.require_unique(right.distinct(), ["k"]).count() == 2


def test_natural_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (None, "b", 6), (2, "c", 7)], "k int, t string, x int")
    right = spark.createDataFrame([("a", 1, 10), ("b", None, 20)], "t string, k int, y int")
    assert joins.common_columns(left, right) == ["k", "t"]
    joined = joins.natural_join(left, right, keys=["t", "k"])
    assert joined.columns == ["k", "t", "x", "y"]
    assert rows(joined) == sorted([(1, "a", 5, 10), (None, "b", 6, 20), (2, "c", 7, None)], key=repr)
    assert rows(joins.natural_join(left, right, null_keys_match=False)) == sorted([(1, "a", 5, 10), (None, "b", 6, None), (2, "c", 7, None)], key=repr)
    assert rows(joins.key_report(left, right)) == [("k", "int", "int", 1, 1), ("t", "string", "string", 0, 0)]
    with pytest.raises(ValueError, match="different types: k"):
        joins.natural_join(left, right.withColumn("k", F.col("k").cast("string")))
    with pytest.raises(ValueError, match="no column in common"):
        joins.natural_join(left, right.select("y"))
    with pytest.raises(ValueError, match="share"):
        joins.natural_join(left, right, keys=["t"])
    audit = Audit()
    with pytest.raises(ValueError, match="NULL in the keys"):
        audit.settled(joins.natural_join(left, right, null_keys_match=False, audit=audit))
    audit = Audit()
    whole = joins.natural_join(left.where("k > 0"), right.where("k > 0"), null_keys_match=False, audit=audit)
    assert audit.settled(whole).count() == 2 and audit.counts()["natural_left"] == {"rows": 2, "null_keys": 0}
