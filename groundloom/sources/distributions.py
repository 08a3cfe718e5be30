"""Sinks of distributions: one long table, and a JSON specification of samplers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "|"


def long_format(distributions: dict[str, tuple[DataFrame, list[str], list[str], str]]) -> DataFrame:
    """distribution, field, key, probability of all; each is given as (rows, given columns, key columns, probability column)."""

    def composite(columns: list[str]) -> Column:
        return F.concat_ws(SEPARATOR, *(F.col(c).cast("string") for c in columns)) if columns else F.lit("")

    parts = [rows.select(F.lit(name).alias("distribution"), composite(given).alias("field"), composite(keys).alias("key"), F.col(p).cast("double").alias("probability")) for name, (rows, given, keys, p) in distributions.items()]
    return reduce(DataFrame.unionByName, parts)


def specifications(long: DataFrame, parents: dict[str, str]) -> DataFrame:
    """name, spec: a JSON document for each distribution; those with a parent have values and weights for each of its values.

    A distribution's vocabulary is collected in one row, so it must be one (tables of categories, not of documents)."""
    items = F.array_sort(F.collect_list(F.struct("key", "probability")))
    split = lambda c: (F.transform(c, lambda x: x["key"]).alias("values"), F.transform(c, lambda x: x["probability"]).alias("weights"))
    given = long.groupBy("distribution", "field").agg(items.alias("items")).select("distribution", "field", F.struct(*split(F.col("items"))).alias("block"))
    blocks = given.groupBy("distribution").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "block")))).alias("blocks"))
    name, blocks_of = F.col("distribution").alias("name"), F.col("blocks")
    parent = F.lit(None).cast("string")
    for k, v in parents.items():
        parent = F.when(F.col("distribution") == k, v).otherwise(parent)
    root = F.struct(name, F.lit("category").alias("type"), F.try_element_at(blocks_of, F.lit("")).getField("values").alias("values"), F.try_element_at(blocks_of, F.lit("")).getField("weights").alias("weights"))
    child = F.struct(name, F.lit("subcategory").alias("type"), parent.alias("parent"), blocks_of.alias("subcategories"))
    return blocks.select(name, F.when(parent.isNull(), F.to_json(root)).otherwise(F.to_json(child)).alias("spec"))


def write_specifications(specs: DataFrame, path: str) -> None:
    specs.select("spec").write.mode("overwrite").text(path)
