"""Checks, corrections, sampling graphs, redraws, sinks: their errors and edge cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from groundloom.functions import scalar as s
from groundloom.operators import checks as ck
from groundloom.operators import generation as g
from groundloom.operators import sampling as sm
from groundloom.operators import statistics as st
from groundloom.plans.graph import Spec, derive, ordered
from groundloom.sources import io


def test_required_and_restricted_columns(spark):
    df = spark.createDataFrame([(1, "a")], "id long, x string")
    with pytest.raises(ValueError, match="missing columns"):
        ck.require(df, ["id", "y"])
    assert ck.restricted(df, ["x", "y", "id"], ("x",)).first() == (None, None, 1)


def test_violations(spark):
    df = spark.createDataFrame([(5, "abc", "k"), (None, "a", "z"), (50, None, None)], "n int, t string, c string")
    rules = [ck.Rule("n", low=1, high=9), ck.Rule("t", lengths=(2, 4)), ck.Rule("c", nullable=True, values=("k",)), ck.Rule("gone")]
    assert [r.x for r in df.select(ck.violations(df, rules).alias("x")).collect()] == [["gone:missing"], ["n:missing", "t:length", "c:value", "gone:missing"], ["n:range", "t:missing", "gone:missing"]]
    assert ck.violations(df.select("n"), []) is not None and df.select(ck.violations(df, [])).first()[0] == ["n:extra", "t:extra", "c:extra"]
    assert ck.pass_rate(df.limit(0), rules, ["c"]).count() == 0


def test_corrections_that_cannot_be_applied(spark):
    rows = spark.createDataFrame([(1, 3), (2, None)], "id long, v int")
    fix = lambda *f: ck.corrected(rows, spark.createDataFrame(list(f), "id long, old_value int, new_value int"), ["id"], "v").collect()
    assert sorted(fix((1, 3, 5))) == [(1, 5, True), (2, None, False)] and (2, 4, True) in fix((2, None, 4))
    for bad, why in (([(1, 3, 5), (1, 3, 4)], "twice"), ([(9, 1, 2)], "no row"), ([(1, 4, 5)], "another value")):
        with pytest.raises(PySparkException, match=why):
            fix(*bad)


def test_classes_joins_and_readiness(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert [r[0] for r in df.select(ck.mapped(F.col("x"), {"a": "A"})).collect()] == ["A", None]
    with pytest.raises(PySparkException, match="no class for a"):
        df.select(ck.mapped(F.col("x"), {"b": "B"})).collect()
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(PySparkException, match="no y for 2"):
        ck.joined_or_error(ids, spark.createDataFrame([(1, "z")], "id long, y string"), "id", "y").collect()
    with pytest.raises(RuntimeError, match="changed"):
        ck.assert_ready({"passed": True, "config": ck.fingerprint({"a": 1})}, {"a": 2})
    with pytest.raises(RuntimeError, match="gate"):
        ck.assert_ready({}, {})
    assert ck.fingerprint({"b": 1, "a": 2}) == ck.fingerprint({"a": 2, "b": 1})


def test_graphs(spark):
    with pytest.raises(ValueError, match="cycle"):
        ordered([Spec("a", ("b",)), Spec("b", ("a",))])
    with pytest.raises(ValueError, match="unknown"):
        ordered([Spec("a", ("q",))])
    with pytest.raises(ValueError, match="more than once"):
        ordered([Spec("a"), Spec("a")])
    specs = [Spec("c", ("b", "id"), lambda: F.col("b") + F.col("id")), Spec("b", ("id",), lambda: F.col("id") * 2)]
    assert derive(spark.createDataFrame([(3,)], "id long"), specs).first() == (3, 6, 9)


def test_sampling(spark):
    rows = spark.createDataFrame([(i,) for i in range(200)], "id long")
    colour = spark.createDataFrame([("", "red", 0.5), ("", "blue", 0.5)], "key string, colour string, probability double")
    size = spark.createDataFrame([("red", "s", 1.0), ("blue", "l", 1.0)], "key string, size string, probability double")
    got = sm.sampled(rows, "id", [{"name": "size", "table": size, "parents": ("colour",)}, {"name": "colour", "table": colour}], 3).collect()
    assert len(got) == 200 and {(r.colour, r["size"]) for r in got} == {("red", "s"), ("blue", "l")} and 60 < sum(r.colour == "red" for r in got) < 140
    with pytest.raises(PySparkException, match="no distribution"):
        sm.sampled(rows, "id", [{"name": "colour", "table": colour}, {"name": "size", "table": size.filter("key = 'red'"), "parents": ("colour",)}], 3).collect()
    with pytest.raises(ValueError, match="needs a name"):
        sm.parsed_spec([{"name": "x"}])
    with pytest.raises(PySparkException, match="no feasible row in 8 draws"):
        rows.select(sm.first_feasible(lambda i: F.struct(i.alias("attempt")), lambda x: x["attempt"] > 100, 8)).collect()
    late = rows.limit(1).select(sm.first_feasible(lambda i: F.struct(i.alias("attempt")), lambda x: x["attempt"] >= 6, 8).alias("x")).first()
    assert late.x.attempt == 6
    assert [r.id for r in sm.sample_rows(rows, "id", 5, 1).collect()] == sorted(r.id for r in sm.shuffled(rows, "id", 1).limit(5).collect())


def test_weights(spark):
    w = spark.createDataFrame([("a", 3.0), ("a", -1.0), ("a", 1.0), ("b", 0.0), ("b", None)], "g string, w double")
    assert sorted((r.g, r.probability) for r in sm.normalised(w, ["g"], "w").collect()) == [("a", 0.0), ("a", 0.25), ("a", 0.75), ("b", 0.5), ("b", 0.5)]


def test_running_sums(spark):
    import random

    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(float(v), v % 7) for v in values], "v double, n long")
    for falling in (False, True):
        total, want = 0, {}
        for v in sorted(values, reverse=falling):
            total += v % 7
            want[v] = total
        assert {r.v: r.run_n for r in st.running(df, "v", ["n"], falling, 16).collect()} == want
    assert st.running(df.limit(0), "v", ["n"]).count() == 0


def test_retry_machine(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(6)], "id long")
    draft = lambda df, a: df.withColumn("text", F.concat(F.lit(f"  try {a} of "), F.col("id").cast("string"), F.lit(" after "), F.size("feedback").cast("string")))
    checks = {"early": lambda t: F.when(F.regexp_extract(t, "try ([0-9])", 1).cast("int") < F.col("id"), F.lit("too early")), "never": lambda t: F.when(F.col("id") == 0, F.lit("never right"))}
    got = {r.id: r for r in g.retry_machine(rows, "id", draft, F.trim, checks, {"early": lambda t: F.lit("try 9 by rule")}, 2, str(tmp_path)).collect()}
    assert [got[i].status for i in range(6)] == ["failed", "accepted", "accepted", "coerced", "coerced", "coerced"]
    assert got[2].text == "try 2 of 2 after 2" and got[2].attempt == 2 and got[2].feedback == ["too early"] * 2
    assert got[0].fault == "never" and got[0].feedback == ["never right"] * 3 and got[3].text == "try 9 by rule" and got[3].fault is None


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'a "{i}", b' if i else None) for i in range(10)], "i long, t string")
    io.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    assert sorted(io.read_csv(spark, str(tmp_path / "c"), "i long, t string").collect(), key=lambda r: r.i) == sorted(rows.collect(), key=lambda r: r.i)
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfid,x\n1,2\n")
    assert io.read_csv(spark, str(tmp_path / "bom.csv")).columns == ["id", "x"]
    io.write_with_provenance(rows, str(tmp_path / "p"), {"source": "test"})
    assert '"n_rows": 10' in spark.read.text(str(tmp_path / "p_provenance")).first().value
    io.append_batches(rows.filter("i < 4"), str(tmp_path / "b"), "i", 2)
    io.append_batches(rows, str(tmp_path / "b"), "i", 2)
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "b")).collect()) == list(range(10))


def test_scalars(spark):
    df = spark.createDataFrame([("(1,234.5)", "old"), ("-", "x")], "n string, a string")
    assert [tuple(r) for r in df.select(s.number(F.col("n")), s.alias(F.col("a"), {"old": "new"})).collect()] == [(1234.5, "new"), (None, "x")]
    assert df.limit(1).select(s.pick(["p", "q"], F.lit(0.5)), s.listed(F.lit("['a', \"b\", ]"))).first() == ("q", ["a", "b"])
