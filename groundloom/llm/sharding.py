"""K-d tree sharding: near-equal bytes, by recursive splits at weighted medians of metadata.

Rows of equal text form one item (size, checksum and 64-bit hash agree), so copies stay together; only a group that holds more than
a whole leaf is dealt by row hash, as many items. Items have coordinates: the ranks of language and source among
their distinct values, size, and least doc_id, each scaled to ``BITS`` bits if its range is wider. Equal values are told apart by a
hash of the item. A node with more than one leaf is split along the dimension that is widest in it, relative to the whole table, at
the weighted quantile that gives each side the bytes of its leaves. An item too heavy for that (the quantile lies inside it,
and either side would miss its bytes by ``CLOSE`` of a leaf) goes whole to the side that it overlaps more, and the quantile is
looked for again among the others.

Everything is a table: quantiles of all nodes of a level are found together by refining histograms of ``BINS`` bins, whose running
sums are windows of a node; items then get their new node by a join. Tables with a row for each node are broadcast (their
number is that of the leaves), and nothing but the totals comes to the driver.

Cases: null text counts as empty: size 1 (the text's bytes plus 1), checksum 0. Null metadata is the lowest
coordinate. Repeated rows are placed like copies. No row: no row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, sized

BINS, BITS, TIE_BITS, CLOSE = 4096, 40, 20, 0.01
#: Items that a group above a leaf becomes, for each leaf that it would fill.
PIECES = 64
DIMENSIONS = ("lang", "source", "size", "first")


def numbered(scratch: Scratch, rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """The rows with ``slot``, their number from 0 in their group: place in a range partition, plus what earlier partitions hold of the group."""
    spark = rows.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    told = scratch.save(dealt.withColumn("mark", F.monotonically_increasing_id()).withColumn("part", F.shiftright("mark", 33)), name)
    held = told.groupBy("part", group).agg(F.count("*").alias("n"), F.min("mark").alias("mark_0"))
    upto = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).select("part", group, "mark_0", "before")
    return told.join(F.broadcast(before), ["part", group]).withColumn("slot", F.col("mark") - F.col("mark_0") + F.col("before")).drop("mark", "part", "mark_0", "before")


def ranked(scratch: Scratch, rows: DataFrame, column: str) -> DataFrame:
    """The rows with a text column replaced by its rank among the distinct values."""
    values = rows.select(F.col(column).alias("value"), F.lit(0).alias("all")).distinct()
    rank = scratch.save(numbered(scratch, values, "all", ["value"], f"{column}-values").select(F.col("value").alias(column), F.col("slot").alias("rank")), f"{column}-ranks")
    return rows.join(sized(rank), column).drop(column).withColumnRenamed("rank", column)


def coordinate(value: Column, low: int, high: int, tie: Column) -> Column:
    """The value, from its least, in BITS bits (wider ranges lose their last bits), then the tie-breaking hash."""
    cut = max(0, (high - low).bit_length() - BITS)
    scaled = F.shiftright(F.coalesce(value, F.lit(low)), cut) - F.lit(low >> cut)
    return F.shiftleft(scaled, TIE_BITS) + tie.bitwiseAND(F.lit((1 << TIE_BITS) - 1))


def shards(spark: SparkSession, docs: DataFrame, count: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. The number of leaves is ``count``, or follows from ``target_bytes``."""
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    raw = docs.select("doc_id", name("lang"), name("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = scratch.save(raw, "raw")
    rows = scratch.save(ranked(scratch, ranked(scratch, rows, "lang"), "source"), "rows")
    facts = [F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("doc_id").alias("first")]
    text_key = ["size", "text_crc32", "h"]
    items = scratch.save(rows.groupBy(*text_key).agg(*facts), "texts")
    ends = items.agg(F.sum("bytes").alias("total"), *(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).first()
    total = ends["total"] or 0
    leaves = count or max(1, -(-total // target_bytes))
    target = max(1.0, total / leaves)
    # groups above a leaf: fewer than leaves
    over = F.broadcast(items.filter(F.col("bytes") > target).select(*text_key, F.ceil(F.col("bytes") * PIECES / F.lit(target)).alias("pieces")))
    salted = rows.join(over, text_key, "left").withColumn("salt", F.expr("pmod(xxhash64(doc_id, 3), pieces)"))
    base = items.join(over, text_key, "left_anti").withColumn("salt", F.lit(None).cast("long")).unionByName(salted.filter("salt is not null").groupBy(*text_key, "salt").agg(*facts))
    tie = F.xxhash64("h", "salt")
    base = base.select(*text_key, "salt", "bytes", F.lit(1).cast("long").alias("node"), *(coordinate(F.col(d), ends[f"lo_{d}"] or 0, ends[f"hi_{d}"] or 0, tie).alias(f"c{i}") for i, d in enumerate(DIMENSIONS)))
    base = scratch.save(base, "items-0")
    whole = base.agg(*(F.max(f"c{i}") - F.min(f"c{i}") for i in range(len(DIMENSIONS)))).first()
    span = [max(1, x or 0) for x in whole]
    nodes = spark.createDataFrame([(1, 0, leaves)], "node long, first int, leaves int")
    most, level = leaves, 0
    while most > 1:
        level += 1
        base = _split(scratch, base, nodes, span, CLOSE * target, level)
        half = F.expr("leaves div 2").cast("int")
        left = F.struct(F.expr("2 * node").alias("node"), F.col("first"), half.alias("leaves"))
        right = F.struct(F.expr("2 * node + 1").alias("node"), (F.col("first") + half).alias("first"), (F.col("leaves") - half).alias("leaves"))
        nodes = scratch.save(nodes.filter("leaves = 1").unionByName(nodes.filter("leaves > 1").select(F.explode(F.array(left, right)).alias("x")).select("x.*")), f"nodes-{level}")
        most = -(-most // 2)
    placed = scratch.save(base.join(F.broadcast(nodes), "node").select(*text_key, F.coalesce("salt", F.lit(-1)).alias("salt"), F.col("first").alias("shard")), "placed")
    keyed = salted.withColumn("salt", F.coalesce("salt", F.lit(-1))).join(placed, [*text_key, "salt"]).select("doc_id", "size", "text_crc32", "shard")
    done = numbered(scratch, keyed, "shard", ["doc_id", F.xxhash64("text_crc32", "size")], "dealt")
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _narrowed(scratch: Scratch, inside: DataFrame, plan: DataFrame, name: str) -> DataFrame:
    """plan (node, lo, hi, want) with lo = hi: the coordinate in which the running sum of ``inside`` (node, c, bytes) reaches what is wanted."""
    upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    turn = 0
    while True:
        met = inside.join(F.broadcast(plan.withColumn("step", F.expr(f"(hi - lo + {BINS}) div {BINS}"))), "node")
        bins = met.withColumn("bin", F.expr(f"if(c < lo, -1L, if(c > hi, {BINS}L, (c - lo) div step))")).groupBy("node", "hi", "want", "bin").agg(F.sum("bytes").alias("bytes"), F.min("c").alias("least"), F.max("c").alias("most"))
        reach = bins.withColumn("run", F.sum("bytes").over(upto)).groupBy("node", "hi", "want").agg(F.min(F.expr(f"if(bin between 0 and {BINS - 1} and run >= want, struct(bin, least, most), null)")).alias("at"))
        # the bin's own ends: few items end the search at once
        plan = scratch.save(reach.select("node", F.coalesce("at.least", "hi").alias("lo"), F.coalesce("at.most", "hi").alias("hi"), "want"), f"{name}-{turn}")
        if not plan.filter("lo < hi").limit(1).count():
            return plan
        turn += 1


def _split(scratch: Scratch, base: DataFrame, nodes: DataFrame, span: list[int], close: float, level: int) -> DataFrame:
    """The items with the node of their half."""
    dims = range(len(span))
    active = F.broadcast(nodes.filter("leaves > 1").select("node", "leaves"))
    ends = base.join(active, "node").groupBy("node", "leaves").agg(F.sum("bytes").alias("bytes"), *(f(f"c{i}").alias(f"{n}{i}") for i in dims for n, f in (("lo", F.min), ("hi", F.max))))
    widest = F.array_max(F.array(*(F.struct(F.expr(f"(hi{i} - lo{i}) / {span[i]}D").alias("width"), F.lit(-i).alias("minus")) for i in dims)))
    plan = scratch.save(ends.select("node", (-widest["minus"]).alias("d"), F.expr("bytes * (leaves div 2) / double(leaves)").alias("want"), F.array(*(F.col(f"lo{i}") for i in dims)).alias("lo"), F.array(*(F.col(f"hi{i}") for i in dims)).alias("hi")), f"plan-{level}")
    chosen = F.array(*(F.col(f"c{i}") for i in dims))[F.col("d")]
    met = scratch.save(base.join(F.broadcast(plan.select("node", "d")), "node", "left").withColumn("c", chosen), f"met-{level}")
    inside = met.filter("c is not null").select("node", "c", "bytes")
    asked = plan.select("node", F.col("lo")[F.col("d")].alias("lo"), F.col("hi")[F.col("d")].alias("hi"), "want")
    cuts, heavy, turn = [], [], 0
    while True:
        at = _narrowed(scratch, inside, asked, f"narrow-{level}-{turn}").select("node", F.col("lo").alias("cut"), "want")
        sides = inside.join(F.broadcast(at), "node").groupBy("node", "cut", "want").agg(F.sum(F.expr("if(c < cut, bytes, 0L)")).alias("below"), F.sum(F.expr("if(c = cut, bytes, 0L)")).alias("held"))
        sides = sides.withColumn("to_left", F.expr("below + held - want <= want - below"))
        sides = scratch.save(sides.withColumn("heavy", F.expr(f"below < want and below + held > want and least(want - below, below + held - want) > {close!r}D")), f"sides-{level}-{turn}")
        cuts.append(sides.filter("not heavy").select("node", F.expr("if(to_left, cut, cut - 1)").alias("cut")))
        more = sides.filter("heavy")
        if not more.limit(1).count():
            break
        heavy.append(more.select("node", F.col("cut").alias("c"), "to_left"))
        # those items are set; the others of their nodes are searched for what they leave
        again = more.select("node", F.col("cut").alias("taken"), F.expr("if(to_left, want - held, want)").alias("want"))
        inside = scratch.save(inside.join(F.broadcast(again.select("node", "taken")), "node").filter("c <> taken").drop("taken"), f"rest-{level}-{turn}")
        asked = inside.groupBy("node").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).join(F.broadcast(again.select("node", "want")), "node").select("node", "lo", "hi", "want")
        asked = scratch.save(asked, f"asked-{level}-{turn}")
        turn += 1
    cut = cuts[0]
    for c in cuts[1:]:
        cut = cut.unionByName(c)
    sent = met.join(F.broadcast(cut), "node", "left")
    side = F.expr("c <= cut")
    if heavy:
        exact = heavy[0]
        for x in heavy[1:]:
            exact = exact.unionByName(x)
        sent = sent.join(sized(exact), ["node", "c"], "left")
        side = F.coalesce(F.col("to_left"), side)
    to = F.when(F.col("c").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(F.coalesce(side, F.lit(True)), F.lit(0)).otherwise(F.lit(1)))
    return scratch.save(sent.select("size", "text_crc32", "h", "salt", "bytes", to.alias("node"), *(f"c{i}" for i in dims)), f"items-{level}")
