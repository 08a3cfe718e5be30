import pytest
from pyspark.sql import functions as F

from groundloom import config
from groundloom.operators import checks


def test_release_checks_columns_counts_and_keys(spark):
    a = spark.createDataFrame([(1, 50, 20, 30)], "id long, age long, years long, debut long")
    b = spark.createDataFrame([(2, 40, 10)], "id long, age long, years long")
    derived = {"debut": F.col("age") - F.col("years")}
    made = checks.release([a, b], ["id", "debut"], "id", 2, derived)
    assert sorted(map(tuple, made.collect())) == [(1, 30), (2, 30)]
    with pytest.raises(ValueError):
        checks.release([a, b], ["id", "debut"], "id", 2)
    with pytest.raises(ValueError, match="3 rows expected"):
        checks.release([a, b], ["id", "debut"], "id", 3, derived)
    with pytest.raises(ValueError, match="repeated"):
        checks.release([a, a], ["id"], "id", 2)
    with pytest.raises(ValueError, match="no runs"):
        checks.release([], ["id"], "id", 0)


def test_settings(tmp_path):
    f = tmp_path / ".env"
    f.write_text("# comment\nGROUNDLOOM_MODEL='small'\nexport GROUNDLOOM_CONCURRENT=8\nOTHER=1\n")
    s = config.load(str(f), {"GROUNDLOOM_CONCURRENT": "2", "groundloom_data_root": "s3://b/d/"})
    assert (s.model, s.concurrent, s.budget, s.folder("pages")) == ("small", 2, 0.0, "s3://b/d/pages")
    with pytest.raises(ValueError):
        config.load(None, {"GROUNDLOOM_CONCURRENT": "many"})
    with pytest.raises(ValueError):
        s.folder("elsewhere")
