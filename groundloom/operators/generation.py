"""State of a batched generation run, retries, list and genericity rules, text repair, calls of a text service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import present_self
from .texts import spans

# Patterns of stock phrases by narrative with the number of different ones that is too many, joined
# list items, batch limits.
GENERIC = {
    "LIVING_GENERICITY": ("living_persona", 3, [r"주중(?:에는)?[^.]{0,60}주말(?:에는)?", "작업 시간을 길게 확보", "생활 동선을 안정적으로 묶", "일상(?:의)? 균형을 유지|생활과 작업을 조화롭게", "시간과 공간을 타협", "작업실과 거주 공간을 (?:병행|함께 사용|별도로 유지|분리)", "회복 시간을 .*?(?:챙기|확보)"]),
    "FAMILY_GENERICITY": ("family_persona", 2, [r"가족과의?\s*(?:시간|일정)\s*조율", r"가족과의?\s*관계를?\s*유지", r"생활\s*책임과\s*작업\s*지속성", r"가까운\s*가족과\s*생활\s*리듬", r"주변\s*돌봄과\s*자기\s*작업\s*시간"]),
    "NETWORK_GENERICITY": ("network_persona", 1, [r"중심적인?\s*(역할|위치)", r"인맥을\s*넓히", r"생태계에서\s*중심", r"관계의\s*운영\s*방식", r"요청이\s*들어오면\s*연결과\s*조율", r"일정\s*충돌과\s*응답\s*속도", r"기존\s*협업선의\s*신뢰"]),
    "SUPPORT_GENERICITY": ("support_persona", 1, [r"실질적인?\s*도움.*기대", r"지원\s*제도를?\s*중요하게\s*여기", r"무엇을\s*기대하고\s*어디서\s*거리감을", r"자원을\s*효율적으로\s*활용", r"안정적인?\s*작업\s*시간\s*확보", r"지원\s*제도는\s*필요할\s*때\s*쓰되"]),
}
NOT_ATOMIC = r"\S+와\s+\S+|\S+과\s+\S+|\S+\s+및\s+\S+|\S+\s+하고\s+\S+|/|,|·"
ITEMS, LEAST_OVERLAP, LEAST_CAP = 5, 3, 4
# Decades of life, years told as employment (before and behind the number), and the sentence that takes their place.
DECADE = r"[1-9]0대(?:\s*이상)?"
EMPLOYED_AFTER, EMPLOYED_BEFORE = r"\s*년(?:간)?\s*(?:동안\s*)?(?:전업|겸업)", r"(?:전업|겸업)\s*(?:으로서|으로|상태로)?\s*"
TOLD_APART, FULL_TIME = ("활동 경력은 ", "년이며 현재는 ", " 상태"), "전업"


# ---- state between batches -----------------------------------------------------------------------


def batch_numbers(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch``: so many rows together by a gapless order number that begins at 0."""
    return rows.withColumn("batch", F.floor(F.col(order) / size))


def used_before(rows: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """keys, batch, used: how often earlier batches had the key. Rows of one batch don't see each other.

    Counts are made before the window, so its partitions hold a row a batch however common a key is."""
    counted = rows.groupBy(*keys, batch).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*keys, batch, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("used"))


def quota(rows_in_run: Column) -> Column:
    """How often a run may use an item: a quarter of its rows, four at least."""
    return F.greatest(F.lit(LEAST_CAP), F.ceil(rows_in_run / 4))


def over_quota(rows: DataFrame, key: str, items: str, cap: int, batch: str = "batch") -> DataFrame:
    """key, blocked: the items of a row that earlier batches have used up, in order of name."""
    each = rows.select(key, batch, F.explode(F.array_distinct(items)).alias("item"))
    spent = used_before(each, ["item"], batch).filter(F.col("used") >= cap).select("item", batch)
    return each.join(spent, ["item", batch]).groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("blocked"))


def seen_sets(rows: DataFrame, key: str, items: str, batch: str = "batch") -> DataFrame:
    """key, seen: whether an earlier batch had a row with the same set of items; empty sets are never seen."""
    sets = rows.select(key, batch, F.array_join(F.array_sort(F.array_distinct(items)), "\u001f").alias("set"))
    known = used_before(sets, ["set"], batch).withColumn("seen", (F.col("used") > 0) & (F.col("set") != ""))
    return sets.join(known, ["set", batch]).select(key, "seen")


# ---- rules of lists and stock phrases ------------------------------------------------------------


def drifts(families: Column, planned: Column) -> Column:
    """Fewer than three families of the plan; without a plan or without items there is no drift."""
    return (F.size(families) > 0) & (F.size(planned) > 0) & (F.size(F.array_intersect(families, planned)) < LEAST_OVERLAP)


def not_atomic(items: Column) -> Column:
    """All items if there aren't five, else those that join several activities."""
    return F.when(F.size(items) != ITEMS, items).otherwise(F.filter(items, lambda x: F.rlike(x, F.lit(NOT_ATOMIC))))


def generic(code: str) -> Column:
    """Whether a row's narrative has too many of the stock phrases of that rule."""
    field, most, patterns = GENERIC[code]
    text = F.coalesce(F.col(field), F.lit(""))
    return sum((F.rlike(text, F.lit(p)).cast("int") for p in patterns), F.lit(0)) >= most


# ---- retries and repair --------------------------------------------------------------------------


def temperature(attempt: Column, base: float, decay: float, least: float) -> Column:
    return F.greatest(F.lit(least), F.lit(base) - attempt * F.lit(decay))


def first_accepted(most: int, draw: Callable[[Column], Column], accept: Callable[[Column], Column]) -> Column:
    """(attempt, value) of the first of ``most`` + 1 attempts that is accepted, null if none is."""
    tried = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda a: F.struct(a.alias("attempt"), draw(a).alias("value")))
    return F.get(F.filter(tried, lambda t: accept(t["value"])), F.lit(0))


def rewritten(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """Each match replaced by what ``new`` makes of its (start, match); everything else stays as it is."""
    between, found = F.split(text, pattern, -1), spans(text, pattern)
    parts = F.zip_with(between, F.transform(found, new), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(parts, "")


def right_decade(text: Column, age: Column) -> Column:
    """Decades of life told of oneself are set to the age's; those of past phases or of others stay."""
    def new(s: Column) -> Column:
        low = F.substring(s["match"], 1, 1).cast("int") * 10
        wrong = present_self(text, s["start"], F.lit(3)) & ~age.between(low, low + 9)
        return F.when(wrong, F.concat((F.floor(age / 10) * 10).cast("string"), F.lit("대"))).otherwise(s["match"])

    return rewritten(text, DECADE, new)


def told_duration(text: Column, years: Column, employment: Column) -> Column:
    """Years of activity told as years of employment are told apart."""
    y, (begin, middle, end) = years.cast("string"), TOLD_APART
    new = F.concat(F.lit(begin), y, F.lit(middle), F.coalesce(F.nullif(employment, F.lit("")), F.lit(FULL_TIME)), F.lit(end))
    first = F.regexp_replace(text, F.concat(y, F.lit(EMPLOYED_AFTER)), new)
    return F.when(years > 0, F.regexp_replace(first, F.concat(F.lit(EMPLOYED_BEFORE), y, F.lit(r"\s*년")), new)).otherwise(text)


def retry_machine(rows: DataFrame, key: str, draft: Callable[[DataFrame, int], DataFrame], repair: Callable[[Column], Column], checks: dict[str, Callable[[Column], Column]], coerce: dict[str, Callable[[Column], Column]], most: int, folder: str) -> DataFrame:
    """key, text, attempt, status, fault, feedback: the drafts of rows, each retried until no check finds a fault.

    In attempt a, ``draft`` adds ``text`` to the rows that are still open (with their ``feedback`` so far), ``repair`` mends it, and the
    checks are asked in their order; a check is a column of what is wrong, null for nothing. The first fault becomes feedback
    of the next attempt. After ``most`` + 1 attempts, a fault that ``coerce`` knows is put right by rule and all checks are asked
    again ("coerced"); what is still wrong is "failed", with its last text. Attempts are written to ``folder``, which all share, so
    a lost executor repeats one attempt at most."""
    spark, done = rows.sparkSession, []

    def faulty(df: DataFrame) -> DataFrame:
        found = F.array_compact(F.array(*(F.when(check(F.col("text")).isNotNull(), F.struct(F.lit(name).alias("name"), check(F.col("text")).alias("told"))) for name, check in checks.items())))
        first = F.get(found, F.lit(0))
        return df.withColumn("fault", first["name"]).withColumn("told", first["told"])

    pending = rows.withColumn("feedback", F.array().cast("array<string>"))
    for attempt in range(most + 1):
        tried = faulty(draft(pending, attempt).withColumn("text", repair(F.col("text")))).withColumn("attempt", F.lit(attempt))
        tried.write.mode("overwrite").parquet(f"{folder}/attempt-{attempt}")
        tried = spark.read.schema(tried.schema).parquet(f"{folder}/attempt-{attempt}")
        done.append(tried.filter("fault is null").withColumn("status", F.lit("accepted")))
        left = tried.filter("fault is not null").withColumn("feedback", F.concat("feedback", F.array("told")))
        pending = left.select(*rows.columns, "feedback")
    mended = F.col("text")
    for name, rule in coerce.items():
        mended = F.when(F.col("fault") == name, rule(F.col("text"))).otherwise(mended)
    last = faulty(left.withColumn("text", mended))
    done.append(last.withColumn("status", F.when(F.col("fault").isNull(), "coerced").otherwise("failed")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(key, "text", "attempt", "status", "fault", "feedback")


# ---- a text service ------------------------------------------------------------------------------

ANSWERS = "text string, attempt int, temperature double, error string"


def complete(prompts: DataFrame, key: str, prompt: str, service: Callable[[], Callable[[str, float], str]], check: Callable[[str], str | None], most: int = 2, base: float = 0.0, decay: float = 0.0, least: float = 0.0) -> DataFrame:
    """key, text, attempt, temperature, error: the first answer that ``check`` finds nothing wrong with, else the last one and what is wrong with it.

    ``service`` opens a client in each Python worker. What ``check`` says, and exceptions of the service, lead to another
    attempt. A resumed run hands in only the keys that aren't done (``sources.io.without_done``)."""
    schema = f"{prompts.select(key).schema[0].name} {prompts.select(key).schema[0].dataType.simpleString()}, {ANSWERS}"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = service()
        for frame in frames:
            rows = []
            for k, p in zip(frame[key], frame[prompt]):
                text, wrong, attempt, heat = None, None, 0, base
                for attempt in range(most + 1):
                    heat = max(least, base - attempt * decay)
                    try:
                        text = ask(p, heat)
                        wrong = check(text)
                    except Exception as e:  # noqa: BLE001  a failed call is a failed attempt
                        wrong = f"{type(e).__name__}: {e}"
                    if wrong is None:
                        break
                rows.append((k, text, attempt, heat, wrong))
            yield pd.DataFrame(rows, columns=[key, "text", "attempt", "temperature", "error"])

    return prompts.select(key, prompt).mapInPandas(batches, schema)
