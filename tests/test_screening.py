from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.operators import charts, screening
from tests.conftest import rows


def test_potency_filter(spark):
    df = spark.createDataFrame(
        [("a", 1.5, 33.0, 0.01), ("b", 1.49, 1.0, 1.0), ("c", 2.0, 33.1, 1.0), ("d", 2.0, 1.0, 0.0), ("50-28-2", 2.0, 1.0, 1.0),
         (None, 2.0, 0.0, 1.0), ("e", None, 1.0, 1.0), ("f", float("-inf"), float("inf"), 1.0)],
        "CASN string, MFC double, LEC double, `Adj.maxmMd` double")
    got = {r["CASN"]: r["logLEC"] for r in screening.potency_filter(df).collect()}
    assert set(got) == {"a", None} and got[None] == float("-inf")


def test_labels(spark):
    tumor, changes, changed = [label for _, label in fixed.MAMMARY_LABELS]
    df = spark.createDataFrame([(1000000.0,), (None,), (0.5,)], "x double")
    assert [r[0] for r in df.select(screening.ac50_label(F.col("x"))).collect()] == ["-", " ", "0.5"]
    df = spark.createDataFrame(
        [("", "considered - tumor"), (fixed.MAMMARY_BOTH, "considered - tumor"), ("", "odd"), (None, None),
         (fixed.MAMMARY_DEV, None), (fixed.MAMMARY_CANCER, None)], "r string, s string")
    assert [r[0] for r in df.select(screening.mammary_label(F.col("r"), F.col("s"))).collect()] == [
        "Tumor" + fixed.PESTICIDE_EFFECT_NOTE, f"{tumor} {changes}", None, None,
        changed, tumor]
    df = spark.createDataFrame([("50-28-2", "higher"), ("1", None), ("2", "lower")], "c string, k string")
    assert [r[0] for r in df.select(screening.override_labels(F.col("k"), F.col("c"))).collect()] == [
        "hormone substrate", "borderline active", "lower"]
    df = spark.createDataFrame([("GSK 1",), ("PD 2",), ("Phenol",), (None,)], "n string")
    assert [r[0] for r in df.select(screening.failed_candidate(F.col("n"))).collect()] == [1, 1, 0, 0]


def test_ingredients(spark):
    products = spark.createDataFrame(
        [("A; B", "RX"), ("a", "OTC"), ("B", "DISCN"), ("C", None), ("; A", "RX"), (None, "RX")], "Ingredient string, Type string")
    counts = screening.ingredient_counts(products)
    assert rows(counts) == [("a", 3), ("b", 1)]
    table = spark.createDataFrame([("A", "1", "E"), ("A", "1", "P"), ("z", "2", "E")],
                                  "`Chemical name` string, CASN string, hormone string")
    assert rows(screening.ingredient_match(table, counts)) == [("A", "1", "a", 3), ("z", "2", "z", None)]


def test_active_products(spark):
    table = spark.createDataFrame([("A", "1"), ("B", "2"), ("C", "3"), ("D", "4")], "`Chemical name` string, CASN string")
    status = spark.createDataFrame([("1", 5, 1), ("2", None, 4), ("4", None, None)],
                                   "CASN string, `Active products` int, `Not active products` int")
    assert rows(screening.active_products(table, status), "CASN", "products") == [("1", "yes"), ("2", "no"), ("3", ""), ("4", "")]


def test_prioritise_three_valued(spark):
    data = [(c, k, s) for c in ("1", "1*", "0", None) for k in ("lower", None, "") for s in (1, 0, None)]
    df = spark.createDataFrame([(f"n{i}", f"c{i}", k, c, s) for i, (c, k, s) in enumerate(data)],
                               "`Chemical name` string, CASN string, `Efficacy/potency` string, Consumer string, Nhanes int")
    ingredients = spark.createDataFrame([("n3",), ("n9",)], "ingredients string")
    pesticides = spark.createDataFrame([("c4", "yes"), ("c20", "no")], "CASN string, products string")
    got = {r["CASN"]: r for r in screening.prioritise(df, ingredients, pesticides).collect()}
    for i, (c, k, s) in enumerate(data):
        fda, epa = i in (3, 9), i == 4
        want = k == "lower" and (c == "1" or s == 1 or fda or epa)
        assert (got[f"c{i}"][fixed.PRIORITY] == "yes") == want, i
        assert (got[f"c{i}"]["FDA approved drug products"], got[f"c{i}"]["EPA approved pesticide products"]) == (
            "yes" if fda else "no", "yes" if epa else "no")


def test_charts(spark):
    ranked = spark.createDataFrame(
        [("Estradiol", "a", "1", 3.84, -0.6, "higher"), ("Estradiol", "GSK", "2", 1.0, 1.0, "lower"),
         ("Progesterone", "a", "1", 11.73, 0.0, "lower"), ("Progesterone", "b", "3", None, 0.0, "lower")],
        "hormone string, `Chemical name` string, CASN string, MFC double, logLEC double, cluster string")
    plotted = charts.plotted(ranked)
    assert rows(charts.cluster_sizes(plotted)) == [("Estradiol", "higher", 1), ("Progesterone", "lower", 2)]
    assert rows(charts.label_window(plotted), "CASN", "hormone", "cluster_order", "parameters") == [
        ("1", "Estradiol", 1, True), ("1", "Progesterone", 3, False), ("3", "Progesterone", 3, False)]
    table = spark.createDataFrame(
        [("a", "1", "Estradiol", "higher", "0.012 (u)"), ("a", "1", "Progesterone", "lower", "0.012 (u)"),
         ("b", "2", "Estradiol", "lower", "0.01 (m)"), ("c", "3", "Progesterone", "intermediate", "2.5 (u)"),
         ("d", "4", "Progesterone", "lower", "0.00001 (m)"), ("e", "5", "Progesterone", None, "9 (u)"),
         ("f", "6", "Estradiol", "lower", "12.3 (m)"), ("g", "7", "Estradiol", "lower", "0.3 (m)")],
        "`Chemical name` string, CASN string, hormone string, `Efficacy/potency` string, `" + fixed.INTAKE + "` string")
    bins = charts.exposure_bins(charts.hormone_sets(table, ["Chemical name", "CASN", fixed.INTAKE]))
    assert rows(bins, "CASN", "hormone", "best_cluster", "intake", "facet", "facet_order") == [
        ("1", "Both", "Higher", 0.012, "low", 1), ("2", "Estradiol", "Lower", 0.01, "low", 1),
        ("3", "Progesterone", "Intermediate", 2.5, "intermediate", 2), ("6", "Estradiol", "Lower", 12.3, "high", 3),
        ("7", "Estradiol", "Lower", 0.3, "low", 1)]


def test_source_and_use_counts(spark):
    cats = list(fixed.SOURCE_LABELS)
    table = spark.createDataFrame(
        [("a", "1", "Estradiol", "1", "0", "1*", None, "0", " "), ("a", "1", "Progesterone", "1", "0", "1*", None, "0", " "),
         ("b", "2", "Estradiol", "1", "1", "0", "0", "0", "1")],
        "n string, c string, hormone string, " + ", ".join(f"`{x}` string" for x in cats))
    long = charts.source_long(table, ["n", "c"])
    assert rows(charts.source_hormone_counts(long, ["n", "c"]), "category", "hormones", "n", "category_order", "Hormone_set") == [
        ("Consumer", "Estradiol", 1, 1, "Estradiol"), ("Consumer", "Estradiol, Progesterone", 1, 1, "Both"),
        ("Diet", "Estradiol", 1, 2, "Estradiol"), ("Industrial", "Estradiol, Progesterone", 1, 3, "Both"),
        ("No exposure source data", "Estradiol", 1, 6, "Estradiol")]
    tokens = spark.createDataFrame([("1", "Fragrance"), ("2", "Fragrance"), ("2", None), ("9", "Plastic")], "casrn string, value string")
    assert rows(charts.use_hormone_counts(tokens, table, "casrn", ["n", "c"], "c")) == [
        ("Estradiol", "Fragrance", 1, "Estradiol"), ("Estradiol, Progesterone", "Fragrance", 1, "Both")]


def test_joins_of_the_integration_share_one_exchange(spark, tmp_path):
    """With nothing broadcast, the long table and each side are exchanged once, however many joins there are."""
    def stored(name, columns):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    potent = stored("potent", "date_chnm_plate string, plate double, chnm string, casn string, LEC_Estradiol double, LEC_Progesterone double,"
                    " MFC_Estradiol double, MFC_Progesterone double, hits_Estradiol string, hits_Progesterone string, AC50_Estradiol double,"
                    " AC50_Progesterone double")
    evidence = stored("evidence", f"chnm string, casn string, Nhanes int, `{fixed.MAMMARY_COLUMN}` string")
    sides = [stored("areas", "CASRN string, `AUC.Agonist` string"), stored("sources", "casrn string, `Cons.` string"),
             stored("pesticides", "CASRN string, status string"), evidence]
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        plan = screening.integrated_long(potent, *sides)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("SortMergeJoin") == 4 and plan.count("Exchange hashpartitioning") == 5
