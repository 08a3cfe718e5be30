"""Report tables on small fixtures."""

import pytest

from groundloom.sources import report_tables as rt

PAGE = "Title 2020\nWriting (1,200) 40.0 60.0 3.5\nMusic (80) 30.5 69.0 1.0\nMusic (81) 1.0 99.0 2.0\nother line"


def pages(spark, text=PAGE):
    return spark.createDataFrame([(1, text)], "page int, text string")


def test_rows_of_a_page(spark):
    found = {r["label"]: r for r in rt.labelled_rows(pages(spark), ["Music", "Writing"], 2, extras=1).collect()}
    assert found["Writing"]["cases"] == 1200 and found["Writing"]["shares"] == [40.0, 60.0] and not found["Writing"]["short"]
    assert found["Music"]["cases"] == 80 and found["Music"]["row_sum"] == 99.5 and not found["Music"]["off"]


def test_missing_label_and_bad_sum_are_errors(spark):
    for labels, hard in ((["Music", "Dance"], None), (["Music", "Writing"], 0.1)):
        with pytest.raises(Exception, match="missing|row sum off"):
            rt.labelled_rows(pages(spark), labels, 2, hard=hard).collect()
    with pytest.raises(Exception, match="missing"):
        rt.labelled_rows(pages(spark, ""), ["Music"], 2).collect()


def test_best_extraction(spark):
    rows = [(1, "a", 0, 10, 5), (1, "b", 1, 12, 5), (1, "c", 1, 13, 5), (2, "d", 0, 9, 5), (3, "e", 0, 11, 1)]
    found = rt.best_extraction(spark.createDataFrame(rows, "page int, file string, priority int, fields int, columns int"), columns=3)
    assert sorted((r["page"], r["file"]) for r in found.collect()) == [(1, "c"), (3, "e")]


def test_spot_checks_and_text_tables(spark):
    table = spark.createDataFrame([("x", 10.2), ("y", 5.0)], "k string, v double")
    want = spark.createDataFrame([("x", 10.0), ("y", 6.0), ("z", 1.0)], "k string, v double")
    assert {r["k"]: r["ok"] for r in rt.spot_checks(table, want, ["k"], "v").collect()} == {"x": True, "y": False, "z": False}
    assert rt.markdown(table, 1) == "| k | v |\n| --- | --- |\n| x | 10.2 |\n| y | 5.0 |\n"
    assert "10.2000" in rt.latex(table)
