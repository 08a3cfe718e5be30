"""Tables of printed reports: rows read from page text, the choice among extractions, provenance, tables written as text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_rows(pages: DataFrame, labels: list[str], columns: int, soft: float = 1.5, hard: float | None = None, extras: int = 0) -> DataFrame:
    """page, line, label, cases, shares, row_sum, off (row sum beyond ``soft``), short (extra numbers missing) of lines ``label (count) number number ...``.

    ``pages`` has page, text. The first line of a label on a page counts. Lines with fewer than ``columns`` numbers are
    no rows. A page that lacks a label, or a row sum beyond ``hard``, is an error when the row or the page is read."""
    line = pages.select("page", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    names = "|".join(re.escape(n) for n in sorted(labels, key=lambda n: (-len(n), n)))
    # fixed values: the forms of a row and of its numbers in the reports
    form = rf"^({names})\s+\(([0-9,]+)\)\s+(.+)$"
    numbers = F.transform(F.regexp_extract_all(F.regexp_extract("raw", form, 3), F.lit(r"-?[\d,]+\.\d+|-?[\d,]+"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    found = line.filter(F.col("raw").rlike(form)).select("page", "line", F.regexp_extract("raw", form, 1).alias("label"), F.regexp_replace(F.regexp_extract("raw", form, 2), ",", "").try_cast("long").alias("cases"), numbers.alias("numbers")).filter(F.size("numbers") >= columns)
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("page", "label").orderBy("line"))).filter("nth = 1")
    total = found.withColumn("shares", F.slice("numbers", 1, columns)).withColumn("row_sum", F.aggregate("shares", F.lit(0.0), lambda a, x: a + x))
    gap = F.abs(F.col("row_sum") - 100)
    if hard is not None:
        total = total.withColumn("row_sum", F.when(gap > hard, F.raise_error(F.concat(F.lit("row sum off: "), "label")).cast("double")).otherwise(F.col("row_sum")))
    seen = pages.select("page").distinct().join(found.groupBy("page").agg(F.count("*").alias("seen")), "page", "left")
    whole = seen.select("page", F.when(F.coalesce("seen", F.lit(0)) < len(labels), F.raise_error(F.concat(F.lit("labels missing on page "), F.col("page").cast("string"))).cast("boolean")).otherwise(True).alias("whole"))
    return total.join(whole, "page", "right").filter("whole").select("page", "line", "label", "cases", "shares", "row_sum", (gap > soft).alias("off"), (F.size("numbers") < columns + extras).alias("short"))


def best_extraction(candidates: DataFrame, enough_fields: int = 12, least_fields: int = 10, columns: int = 1) -> DataFrame:
    """Of candidates (page, file, priority, fields, columns), one a page: by least priority, most fields, most columns, the
    first with enough fields and columns, else the first with the least number of fields."""
    full = (F.col("fields") >= enough_fields) & (F.col("columns") >= columns)
    order = Window.partitionBy("page").orderBy(F.desc(full.cast("int")), "priority", F.desc("fields"), F.desc("columns"), "file")
    return candidates.filter(full | (F.col("fields") >= least_fields)).withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def provenance(shares: DataFrame, label: str, share: str, cases: str, total: float, tolerance: float = 1e-6) -> DataFrame:
    """One row: n_rows, n_labels, row sums within the tolerance, and whether the cases of all labels come within 5 % of the grand total."""
    by = shares.groupBy(label).agg(F.sum(share).alias("s"), F.max(cases).alias("c"), F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_labels"), F.max(F.abs(F.col("s") - 1)).alias("worst"), F.sum("c").cast("double").alias("cases")).select("n_rows", "n_labels", (F.col("worst") <= tolerance).alias("sums_ok"), (F.abs(F.col("cases") - total) <= 0.05 * total).alias("total_ok"))


def spot_checks(table: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float = 0.5) -> DataFrame:
    """keys, expected, found, ok for each expected cell; a missing cell is not ok."""
    joined = expected.withColumnRenamed(value, "expected").join(table.select(*keys, F.col(value).alias("found")), keys, "left")
    return joined.withColumn("ok", F.coalesce(F.abs(F.col("expected") - F.col("found")) <= tolerance, F.lit(False)))


def markdown(report: DataFrame, places: int = 4) -> str:
    """A report (few rows by its nature) as a Markdown table."""
    text = lambda v: "-" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v).replace("|", r"\|")
    lines = [report.columns, ["---"] * len(report.columns), *(list(map(text, row)) for row in report.collect())]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in lines) + "\n"


def latex(report: DataFrame, places: int = 4) -> str:
    """A report as a LaTeX tabular."""
    special = str.maketrans({c: "\\" + c for c in "&%$#_{}"})
    text = lambda v: "--" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v).translate(special)
    body = [" & ".join(map(text, row)) + r" \\" for row in [report.columns, *report.collect()]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(report.columns)}}}", body[0], r"\hline", *body[1:], r"\end{tabular}"]) + "\n"
