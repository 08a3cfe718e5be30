"""The batch loop: snapshots inside a batch, state between batches, and a run that breaks off."""

import pytest
from pyspark.sql import functions as F

from groundloom.streaming import batches


def plain(rows, cap):
    """Rows (id, batch, item): blocked if earlier batches have used the item ``cap`` times."""
    used, sets, late, out = {}, set(), [], []
    for b in sorted({r[1] for r in rows}):
        mine = [r for r in rows if r[1] == b]
        told = [(i, b, item, used.get(item, 0) >= cap, item in sets, item in late) for i, _, item in mine]
        out += told
        for i, _, item, blocked, *_ in sorted(told):
            if not blocked and item is not None:
                used[item] = used.get(item, 0) + 1
                sets.add(item)
                late = [item, *late][:3]
    return sorted(out)


def decide(cap, broken=None):
    def inner(rows, state):
        if broken == state.batch:
            raise RuntimeError("lost")
        flag = lambda df, name: df.select("key").distinct().withColumn(name, F.lit(True))
        told = rows.withColumn("key", F.col("item"))
        for name, df in (("blocked", state.blocked("item", cap)), ("seen", state.seen("item")), ("late", state.latest("item"))):
            told = told.join(flag(df, name), "key", "left")
        no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
        return told.select("id", "item", no("blocked"), no("seen"), no("late"), (~F.coalesce("blocked", F.lit(False))).alias("fine"))

    return inner


KEPT = batches.Kept(counters={"item": "item"}, sets={"item": "item"}, latest={"item": ("item", "id", 3)}, accepted="fine")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, i // 8, None if i % 13 == 5 else "abcde"[i * i % 5]) for i in range(40)]
    path = str(tmp_path_factory.mktemp("batches") / "input")
    batches.write_batches(spark.createDataFrame(rows, "id long, batch long, item string"), "batch", path)
    return rows, path


def result(frame):
    return sorted((r.id, r.batch, r.item, r.blocked, r.seen, r.late) for r in frame.collect())


def test_batches_see_what_earlier_ones_did(spark, folder, tmp_path):
    rows, path = folder
    got = batches.run_batches(spark, path, "id long, item string", str(tmp_path / "run"), decide(4), KEPT)
    assert result(got) == plain(rows, 4)


def test_a_run_that_breaks_off_ends_like_one_that_does_not(spark, folder, tmp_path):
    rows, path = folder
    root = str(tmp_path / "run")
    for broken in (2, 4):
        with pytest.raises(Exception, match="lost"):
            batches.run_batches(spark, path, "id long, item string", root, decide(4, broken), KEPT)
    got = batches.run_batches(spark, path, "id long, item string", root, decide(4), KEPT)
    assert result(got) == plain(rows, 4)
    # nothing is left to do
    assert result(batches.run_batches(spark, path, "id long, item string", root, decide(4, 0), KEPT)) == plain(rows, 4)
