"""A generation run over the events as a stream of batches with counters, sets and a recency list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, shared_folder, table
from .functions import scalar as s
from .operators import ranking as rk
from .queries_grounding import u_sql
from .streaming import batches

#: Stand-ins for items and their families; batches of the run; draws of a row; how many latest families count; share of a batch's rows that one item may have had.
ITEMS, FAMILIES, BATCHES, DRAWN, RECENT, SHARE = 30, 6, 6, 4, 24, 0.05


def rows(spark: SparkSession, d: str) -> DataFrame:
    """event_id, place, size, batch, and the items and families a row may choose from."""
    events = table(spark, d, "events").select("event_id")
    placed = rk.numbered(events, [], s.uniform(51, F.col("event_id"), "order"), "event_id")
    drawn = F.array(*(F.floor(s.uniform(51, F.col("event_id"), f"item{i}") * ITEMS).cast("int") for i in range(DRAWN)))
    return placed.select("event_id", "place", "size", F.expr(f"(place - 1) * {BATCHES} div size").alias("batch"), drawn.alias("drawn"))


SCHEMA = "event_id long, place long, size long, drawn array<int>"


def decide(some: DataFrame, state: batches.Snapshot) -> DataFrame:
    """The least penalised item of each row: 100 if it is used up, 10 if its family is among the latest, then how often it was used, then the draw's number."""
    used = state.counts("item").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("used"))  # a vocabulary
    late = state.latest("family").agg(F.collect_set("key").alias("late"))
    seen = state.seen("set").distinct().withColumn("seen", F.lit(True))
    n = lambda x: F.coalesce(F.try_element_at("used", x.cast("string")), F.lit(0))
    cost = lambda x, i: F.struct((F.when(n(x) >= F.col("size") * SHARE, 100).otherwise(0) + F.when(F.array_contains("late", (x % FAMILIES).cast("string")), 10).otherwise(0)).alias("penalty"), n(x).alias("used"), i.alias("i"), x.alias("item"))
    best = F.array_min(F.transform("drawn", cost))
    told = some.crossJoin(F.broadcast(used)).crossJoin(F.broadcast(late)).withColumn("best", best).withColumn("key", s.set_text(F.col("drawn")))
    told = told.join(rk.sized(seen), "key", "left")
    return told.select("event_id", "place", F.col("best.item").alias("item"), (F.col("best.item") % FAMILIES).alias("family"), F.col("best.penalty").alias("penalty"), F.coalesce("seen", F.lit(False)).alias("seen"), F.col("key").alias("set"))


_COST = f"CASE WHEN counts[x + 1] >= size * {SHARE} THEN 100 ELSE 0 END + CASE WHEN list_contains(late, x % {FAMILIES}) THEN 10 ELSE 0 END"
_BEST = f"list_min(list_transform(drawn, lambda x, i: {{'penalty': {_COST}, 'used': counts[x + 1], 'i': i, 'item': x}}))"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, row_number() OVER (ORDER BY {u_sql(51, 'event_id', 'order')}, event_id) AS place, count(*) OVER () AS size FROM events),
r AS MATERIALIZED (SELECT event_id, place, size, (place - 1) * {BATCHES} // size AS batch, [{', '.join(f"CAST(floor({u_sql(51, 'event_id', f'item{i}')} * {ITEMS}) AS INT)" for i in range(DRAWN))}] AS drawn FROM e),
state AS (SELECT CAST(0 AS BIGINT) AS batch, list_transform(range({ITEMS}), lambda i: CAST(0 AS BIGINT)) AS counts, CAST([] AS INT[]) AS late
  UNION ALL SELECT batch + 1, list_transform(range({ITEMS}), lambda i: counts[i + 1] + len(list_filter(chosen, lambda c: c = i))), list_slice(list_concat(list_transform(chosen, lambda c: c % {FAMILIES}), late), 1, {RECENT})
  FROM (SELECT s.batch, s.counts, s.late, list(best.item ORDER BY place DESC) AS chosen FROM (SELECT s.*, r.place, {_BEST} AS best FROM state s JOIN r ON r.batch = s.batch) s GROUP BY ALL)),
k AS (SELECT *, array_to_string(list_sort(list_distinct(drawn)), ',') AS key FROM r), f AS (SELECT key, min(batch) AS first FROM k GROUP BY key),
c AS (SELECT event_id, k.batch, first < k.batch AS seen, {_BEST} AS best FROM k JOIN f USING (key) JOIN state s ON s.batch = k.batch)
SELECT event_id, CAST(batch AS INT) AS batch, CAST(best.item AS INT) AS item, CAST(best.penalty AS INT) AS penalty, seen FROM c""")
def batch_loop_choices(spark, d):
    """Items chosen in {BATCHES} batches: choices feed back into counters and the recency list from batch to batch."""
    root = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    batches.write_batches(rows(spark, d), "batch", f"{root}/input")
    done = batches.run_batches(spark, f"{root}/input", SCHEMA, f"{root}/run", decide, KEPT)
    return done.select("event_id", F.col("batch").cast("int").alias("batch"), "item", "penalty", "seen")


KEPT = batches.Kept(counters={"item": "item"}, sets={"set": "set"}, latest={"family": ("family", "place", RECENT)})
