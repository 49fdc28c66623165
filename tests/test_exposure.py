from dosescreen.operators import exposure
from dosescreen.session import stage_tables, use_checkpoints
from tests.conftest import rows
from workload import exposure_queries

RECORD = "cpdat_substance_record_id"


def records(spark, data):
    return spark.createDataFrame(data, f"source string, cassette string, {RECORD} int, casrn string")


def categories(spark, data):
    out = exposure.categorise(records(spark, [(s, c, i, "x") for i, (s, c) in enumerate(data)]))
    return [r["cassette4"] for r in out.orderBy(RECORD).collect()]


def test_broad_categories(spark):
    assert categories(spark, [
        ("Cat", "pesticide|consumer_use"), ("Cat", "drug|consumer_use"), ("Cat", "food_contact"),
        ("Retail list", "shoes"), ("Retail list", "food|shoes"), ("Cat", "indoor|apparel"), ("Cat", "carpet"),
        ("Industrial", "apparel|food"), ("Cat", None), ("Cat", "disinfectant"), ("Cat", "soap|disinfectant"),
        ("Cat", "extermination"), ("Cat", "other|food"), ("Drug bank", "x"), ("Functional Use", "y"),
    ]) == [
        # a source term decides before the consumer label is looked at: the whole path names consumer use
        "pest. ,cons.", "cons.", "diet", "cons.", "diet", "indoor", "cons.", "ind.", None,
        "pest.", "cons., pest.", "pest., pest.", "other, diet", "pharma.", "functional",
    ]


def test_catalogue_records(spark):
    paths = spark.createDataFrame(
        [("s", "a|b", 1, "url1"), ("s", "a|b", 1, "url2"), ("s", "discontinued", 1, "u"), ("s", None, 2, "u"),
         ("s", "a", 3, "u"), ("s", "a", 4, "u")], f"source string, cassette string, {RECORD} int, url string")
    ids = spark.createDataFrame([(1, "c1"), (2, "c1"), (3, "other"), (4, None)], f"{RECORD} int, casrn string")
    universe = spark.createDataFrame([("c1",), (None,)], "casn string")
    got = exposure.catalogue_records(paths, ids, universe)
    assert rows(got, "cassette", RECORD, "repeats", "casrn") == [("a|b", 1, 2, "c1"), (None, 2, 1, "c1")]


def test_products(spark):
    ids = spark.createDataFrame([(1, "c1"), (2, "c2")], f"{RECORD} int, casrn string")
    ingredients = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], f"{RECORD} int, product_id int")
    products = spark.createDataFrame([(10, "herbicide", "s"), (11, None, "s")],
                                     "product_id int, product_use_category string, source string")
    universe = spark.createDataFrame([("c1",)], "casn string")
    got = exposure.categorise_products(exposure.product_uses(ids, ingredients, products, universe))
    assert rows(got) == [("c1", "herbicide", "s", 1, "pest., cons.")]


def test_flags_and_uses_agree_with_summary(spark):
    known = records(spark, [
        ("Cat", "pesticide|consumer_use", 1, "c1"), ("Cat", "drinking_water", 2, "c1"), ("Cat", "weird", 3, "c2"),
        ("Cat", "personal_care|hair_dye", 4, "c1"),
    ])
    used = spark.createDataFrame([("c1", "personal care air freshener", "s"), ("c3", "toys", "s")],
                                 "casrn string, product_use_category string, source string")
    flags = exposure.category_flags([exposure.categorise(known), exposure.categorise_products(used)])
    assert rows(flags, "casrn", "broad", "Cons.", "Diet", "Pest.", "Uncategorized Use") == [
        ("c1", "Cons., Diet, Pest. ,Cons.", "1", "1", "1", "0"), ("c2", "Weird", "0", "0", "0", "1"),
        ("c3", "Cons.", "1", "0", "0", "0")]
    uses = exposure.specific_uses([exposure.catalogue_uses(known), exposure.product_specific_uses(used)])
    assert rows(uses) == [
        ("c1", " Drinking water contaminant, Pers., Fragrance, Pers., Hair dye"), ("c2", " "), ("c3", " ")]
    summary = exposure.source_summary(known, used)
    joined = {r["casrn"]: r["Other"] for r in uses.collect()}
    assert {r["casrn"]: r["Other"] for r in summary.collect()} == joined
    assert rows(summary.drop("Other").select(*[f"`{c}`" for c in flags.columns])) == rows(flags)


def test_predictions(spark):
    summary = spark.createDataFrame([("c1", "b", "0", "0", "1", "0", "0", "0", "x"), ("c2", "b", "1", "1", "1", "1", "1", "0", "y")],
        "casrn string, broad string, `Cons.` string, Diet string, `Ind.` string, `Pharma.` string, `Pest.` string, "
        "`Uncategorized Use` string, Other string")
    universe = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",)], "casn string")
    predicted = spark.createDataFrame([("c1", "All Four"), ("c3", "Unknown"), ("c4", "Dietary, Pesticide")],
                                      "CAS string, Pathway string")
    got = exposure.with_predictions(summary, universe, predicted)
    assert rows(got, "casrn", "Cons.", "Diet", "Ind.", "Pest.", "No Toxcast Info.") == [
        ("c1", "1*", "1*", "1", "1*", " "), ("c2", "1", "1", "1", "1", " "), ("c3", None, None, None, None, "1"),
        ("c4", None, "1*", None, "1*", " ")]


def test_tokens(spark):
    table = spark.createDataFrame(
        [("a", "Fragrance, Fragrance,Fragrance"), ("b", " , Pers., Hair Dye"), ("c", ""), ("d", None)],
        "casrn string, Other string")
    assert rows(exposure.use_tokens(table)) == [
        ("a", 1, "Fragrance"), ("a", 2, "Fragrance"), ("b", 2, "Personal care"), ("b", 3, "Hair Dye")]
    assert rows(exposure.tokens_to_rows(table), "casrn", "source", "value") == [
        ("a", "V1", "Fragrance"), ("a", "V2", "Fragrance"), ("b", "V2", "Personal care"), ("b", "V3", "Hair Dye"),
        ("c", None, None), ("d", None, None)]
    assert rows(exposure.tidy_sources(table)) == [
        ("a", "fragrance, fragrance"), ("b", "personal care, hair dye"), ("c", ""), ("d", "")]
    assert rows(exposure.rows_to_tokens(exposure.use_tokens(table))) == [
        ("a", "fragrance, fragrance"), ("b", "personal care, hair dye")]


def test_rules_run_on_distinct_paths(spark):
    """Every pattern is tried behind the aggregation that leaves each path once."""
    known = records(spark, [("Cat", "pesticide|consumer_use", i, "c1") for i in range(50)] + [(None, None, 99, "c2")])
    used = spark.createDataFrame([("c1", "toys", "s")] * 5, "casrn string, product_use_category string, source string")
    for out in (exposure.categorise(known), exposure.catalogue_uses(known), exposure.product_specific_uses(used)):
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        distinct = next(i for i, line in enumerate(plan) if "Aggregate [" in line)
        # what the aggregation puts out is computed once for each path
        assert any("RLIKE" in line for line in plan[:distinct + 1]) and not any("RLIKE" in line for line in plan[distinct + 1:])
    assert exposure.categorise(known).count() == 51 and exposure.categorise(known).columns[:4] == known.columns


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_catalogue_rows_are_exchanged_once(spark):
    """The lines go by record to the join, and are counted there; NULL and repeated keys as before."""
    paths = spark.createDataFrame(
        [("s", "a", 1, "x")] * 3 + [("s", None, 1, "x"), (None, None, 1, "x"), ("t", "a", None, "x"), ("s", "a", 2, "x")],
        f"source string, cassette string, {RECORD} int, casrn string")
    ids = spark.createDataFrame([(1, "c1"), (1, "c1"), (1, "c2"), (2, None), (None, "c1")], f"{RECORD} int, casrn string")
    universe = spark.createDataFrame([("c1",), ("c1",), ("c2",)], "casn string")
    got = exposure.catalogue_records(paths, ids, universe)
    assert got.columns == ["source", "cassette", RECORD, "repeats", "casrn"]
    assert rows(got) == sorted([r for c in ("c1", "c2") for r in (
        ("s", "a", 1, 3, c), ("s", None, 1, 1, c), (None, None, 1, 1, c))], key=repr)
    assert exchanges(got) and not any("cassette" in line for line in exchanges(got))


def test_summary_labels_are_settled(spark):
    """Neither rules nor title case run on rows, and rows are not dealt out by the few values that labels come from."""
    known = records(spark, [("Cat", "personal_care|hair_dye", i, "c1") for i in range(20)] + [
        (None, None, 30, "c1"), (None, None, 31, "c2"), ("Retail", "shoes", 32, None), ("Cat", "soap|a_b", 33, "c4")])
    used = spark.createDataFrame(
        [("c1", "herbicide", "s"), ("c1", "herbicide", "t"), ("c3", "toys", None), ("c3", None, "s"), (None, "toys", "s")],
        "casrn string, product_use_category string, source string")
    summary = exposure.source_summary(known, used)
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    labelling = plan[plan.index("Union"):]
    assert "RLIKE" not in labelling and "regexp_extract_all" not in plan
    assert not any(f in line for line in exchanges(summary) for f in ("cassette", "product_use_category"))
    flags = exposure.category_flags([exposure.categorise(known), exposure.categorise_products(used)])
    uses = exposure.specific_uses([exposure.catalogue_uses(known), exposure.product_specific_uses(used)])
    assert rows(summary, *flags.columns) == rows(flags)
    assert rows(summary, "casrn", "Other") == rows(uses, "casrn", "Other")
    assert {r["casrn"]: r["broad"] for r in summary.collect()} == {
        "c1": "Cons., Pest., Cons.", "c2": "", "c3": "Cons.", "c4": "Cons.", None: "Cons."}


def test_predicted_uses_to_rows(spark):
    """From records to token rows: the cells' texts are made before any row is, whichever query reads them."""
    known = records(spark, [("Cat", "personal_care|hair_dye", i, "c1") for i in range(9)] + [(None, None, 9, "c2")])
    used = spark.createDataFrame([("c1", "toys", "s"), ("c1", "toys", "t")],
                                 "casrn string, product_use_category string, source string")
    universe = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "casn string")
    predictions = spark.createDataFrame([("c1", "Dietary"), ("c3", "Unknown")], "CAS string, Pathway string")
    table = exposure.with_predictions(exposure.source_summary(known, used), universe, predictions)
    got = exposure.tokens_to_rows(table)
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got, "casrn", "source", "value", "Cons.", "Diet", "No Toxcast Info.") == [
        ("c1", "V1", "Personal care", "1", "1*", " "), ("c1", "V2", "Hair dye", "1", "1*", " "),
        ("c2", None, None, "0", "0", " "), ("c3", None, None, None, None, "1")]


def test_lines_meet_as_numbers_of_labels(spark, tmp_path):
    """What is settled grows with paths and products, not with lines; more than 64 texts, NULL paths and repeated lines."""
    lines, n = 900, 180
    tables = {
        "part": spark.range(n).selectExpr(
            "id AS p_partkey", "'B' AS p_brand", "CAST(id % 5 + 1 AS INT) AS p_size",
            "IF(id = 7, NULL, concat(element_at(array('small', 'red', 'word'), CAST(id % 3 + 1 AS INT)), id, "
            "element_at(array(' ring', ' anvil x', ' w', ''), CAST(id % 4 + 1 AS INT)))) AS p_name",
            "IF(id = 8, NULL, concat('LARGE', id % 2)) AS p_type"),
        "lineitem": spark.range(lines).selectExpr(
            "IF(id = 9, NULL, id % 100) AS l_orderkey", f"IF(id = 11, NULL, id % {n}) AS l_partkey",
            "IF(id % 50 = 0, NULL, 'R') AS l_returnflag", "IF(id % 2 = 0, 'F', 'O') AS l_linestatus"),
        "orders": spark.range(110).selectExpr("id % 100 AS o_orderkey", "IF(id = 3, NULL, id % 6) AS o_custkey"),
        "customer": spark.range(8).selectExpr("id % 7 + 1 AS c_custkey", "IF(id % 7 = 2, 'BUILDING', 'HOUSEHOLD') AS c_mktsegment"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    before = stage_tables(spark)
    got = exposure_queries.predicted_table(spark, str(tmp_path))
    folder = use_checkpoints(spark)
    settled = [spark.read.parquet(f"{folder}/{name}").count() for name in stage_tables(spark) - before]
    assert settled and max(settled) < lines / 2
    known, used = (f(spark, str(tmp_path)) for f in (exposure_queries.records, exposure_queries.product_rows))
    flags = exposure.category_flags([exposure.categorise(known), exposure.categorise_products(used)])
    uses = exposure.specific_uses([exposure.catalogue_uses(known), exposure.product_specific_uses(used)])
    assert len({b for r in flags.collect() for b in r["broad"].split(", ")}) > 64
    listed = exposure_queries.table(spark, str(tmp_path), "customer")
    predictions = listed.selectExpr("c_custkey AS CAS", "IF(c_mktsegment = 'BUILDING', 'Unknown', 'Consumer') AS Pathway")
    universe = listed.selectExpr("c_custkey AS casn")
    want = exposure.with_predictions(flags.join(uses, "casrn", "full"), universe, predictions)
    assert rows(got, *want.columns) == rows(want)
    # the count of a record's lines is not read, and no path is dealt out
    assert "count(1)" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f in line for line in exchanges(got) for f in ("cassette", "product_use_category", "product_id"))
