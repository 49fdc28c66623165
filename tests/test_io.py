import os
import re

import pytest

from dosescreen.session import cut_lineage, scratch
from dosescreen.sources import readers, writers
from tests.conftest import rows


def save(path, text):
    path.write_text(text)
    return str(path)


def test_tabs_schema_and_missing(spark, tmp_path):
    path = save(tmp_path / "w.tsv", "spid\tuM\tconc_index\nDMSO\t1.5\t1\nx\tNA\ttwo\n")
    df = readers.read_tabs(spark, path, "wells")
    assert dict(df.dtypes) == {"spid": "string", "uM": "double", "conc_index": "int"}
    assert rows(df) == [("DMSO", 1.5, 1), ("x", None, None)]
    raw = readers.read_delimited(spark, path, sep="\t")
    assert rows(readers.bad_values(raw, readers.SCHEMAS["wells"])) == [("conc_index", 2, 1)]


def test_commas_quotes_and_empty(spark, tmp_path):
    path = save(tmp_path / "c.csv", 'casn,name\n\'50-00-0,"a, b"\n,""\n')
    df = readers.without_guard(readers.read_commas(spark, path), "casn")
    assert rows(df) == [("50-00-0", "a, b"), (None, None)]


def test_tildes_short_rows(spark, tmp_path):
    path = save(tmp_path / "p.txt", 'Ingredient~Type~Name\nA; "B~RX~n\nC~OTC\n')
    assert rows(readers.read_tildes(spark, path)) == [('A; "B', "RX", "n"), ("C", "OTC", "")]


def test_skipped_lines(spark, tmp_path):
    path = save(tmp_path / "l.csv", "Title line\n\nas of 2021\nChemical,CAS No.\nx,1-1-1\ny,---\n")
    df = readers.read_commas(spark, path, skip=3)
    assert df.columns == ["Chemical", "CAS No."] and rows(df) == [("x", "1-1-1"), ("y", "---")]


def test_blank_tildes_are_texts(spark, tmp_path):
    path = save(tmp_path / "p.txt", "Ingredient~Type~Name\nIBUPROFEN~\nX~NA~y\n~RX~\n")
    assert rows(readers.read_tildes(spark, path)) == [("", "RX", ""), ("IBUPROFEN", "", ""), ("X", None, "y")]


def test_skipped_lines_by_position(spark, tmp_path):
    folder = tmp_path / "lists"
    folder.mkdir()
    save(folder / "a.csv", 'Title\n"odd\n,e,p\nC1,Title,1\nC2,"a\nb",2\n')
    save(folder / "b.csv", "Other\n\n,e,p\nC1,Title,1\ne,p,3\n")
    df = readers.read_delimited(spark, str(folder), skip=2, multiline=True)
    assert df.columns == ["code", "e", "p"]
    assert rows(df) == [("C1", "Title", "1"), ("C1", "Title", "1"), ("C2", "a\nb", "2"), ("e", "p", "3")]


def test_matrix_with_unnamed_key(spark, tmp_path):
    path = save(tmp_path / "m.csv", ",A_up,B_up,C\nC1,1.5,NA,x\nC2,1000000,2,y\n")
    df = readers.read_matrix(spark, path, ["A_up", "B_up"])
    assert df.columns == ["code", "A_up", "B_up"] and rows(df) == [("C1", 1.5, None), ("C2", 1000000.0, 2.0)]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("1-1-1", 1e-5), ("2", None), ("3", 33.0)], "CASN string, x double")
    writers.write_published(df, str(tmp_path / "out"), guard="CASN")
    back = readers.typed(readers.read_delimited(spark, str(tmp_path / "out")), {"x": "double"})
    assert rows(back) == [("'1-1-1", 1e-5), ("'2", None), ("'3", 33.0)]
    assert rows(readers.read_delimited(spark, str(tmp_path / "out")), "x") == [("0.00001",), ("33",), (None,)]
    writers.write_stage(df, str(tmp_path / "stage"))
    assert rows(spark.read.parquet(str(tmp_path / "stage"))) == rows(df)
    assert rows(readers.land(df, str(tmp_path / "landed"))) == rows(df)


def test_cut_lineage_keeps_odd_names(spark):
    df = spark.createDataFrame([(1, "a")], "`No effect >= 100 mg/kg-day (Db), {x}` int, `Cons.` string")
    cut = cut_lineage(df)
    assert cut.columns == df.columns and rows(cut) == rows(df)


def test_scratch_tables_go_after_a_failure(spark):
    kept = cut_lineage(spark.range(3))
    with pytest.raises(ZeroDivisionError), scratch(spark):
        inside = cut_lineage(spark.range(5))
        assert inside.count() == 5
        1 / 0
    assert kept.count() == 3
    assert not os.path.exists(inside.inputFiles()[0].removeprefix("file://"))


@pytest.mark.parametrize("block", ["9", "64", "1m"])
def test_lines_are_numbered_in_blocks_of_any_size(spark, tmp_path, block):
    folder = tmp_path / "lists"
    folder.mkdir()
    save(folder / "a.csv", "Title\nsecond\n,e,e\n" + "".join(f"C{i},{i},x\n" for i in range(40)))
    save(folder / "b.csv", "Other\n\n\n,e,e\nD1,1,\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = readers.numbered_lines(spark, str(folder))
        found = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in lines.collect())
        df = readers.read_commas(spark, str(folder), skip=2)
        assert df.columns == ["code", "e1", "e2"]
        assert rows(df) == sorted([(f"C{i}", str(i), "x") for i in range(40)] + [("D1", "1", None)], key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(f.name, k + 1, v) for f in (folder / "a.csv", folder / "b.csv") for k, v in enumerate(f.read_text().splitlines())]
    assert found == sorted(want)


def test_rejected_rows(spark, tmp_path):
    path = save(tmp_path / "w.csv", 'title\nname,uM,n\n"a, b",1.5,1\n"c,""d",x,2\nonly\n\ne,2,3,4\nf,NA,2.5\n')
    found = readers.rejected_rows(spark, path, {"uM": "double", "n": "int", "other": "int"}, skip=1)
    assert rows(found, "line", "reason", "columns", "raw") == sorted([
        (4, "type", "uM", '"c,""d",x,2'), (5, "short", "", "only"), (7, "long", "", "e,2,3,4"), (8, "type", "n", "f,NA,2.5"),
    ], key=repr)
    assert {r["file"].rsplit("/", 1)[1] for r in found.collect()} == {"w.csv"}


def test_landed_matrix(spark, tmp_path):
    path = save(tmp_path / "m.csv", ",A up,B_up,C\nC1,1.5,NA,7\nC2,1000000,2,y\nC2,3,NA,8\n")
    landed = readers.land_matrix(spark, path, str(tmp_path / "landed"))
    assert landed.count() == 9
    df = readers.read_landed(spark, str(tmp_path / "landed"), ["A up", "B_up"])
    assert rows(df, "code", "A up", "B_up") == [("C1", 1.5, None), ("C2", 1000000.0, 2.0), ("C2", 3.0, None)]
    one = readers.read_landed(spark, str(tmp_path / "landed"), ["C"])
    assert rows(one) == [("C1", 7.0), ("C2", 8.0), ("C2", None)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(name#\d+ = C\)", plan)
