"""Column functions: reproducible draws, casts, text and list scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, row: Column, stage: str) -> Column:
    """A double in [0, 1) that depends on nothing but seed, row and stage: 32 bits of an md5."""
    return _unit(F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.lit(stage)))


def uniform_at(seed: int, row: Column, stage: str, attempt: Column) -> Column:
    """The draw of a numbered attempt."""
    return _unit(F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.concat(F.lit(stage), attempt.cast("string"))))


def _unit(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(options: list, u: Column) -> Column:
    """A uniform choice among literals."""
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(u * len(options)) + 1).cast("int"))


def integer_in(lo: Column, hi: Column, u: Column) -> Column:
    return lo + F.floor(u * (hi - lo + 1)).cast("int")


def number(text: Column) -> Column:
    """A number literal without thousands separators, brackets and per cent signs; dashes and blanks are null."""
    bare = F.regexp_replace(F.trim(text), r"[,()%\s]", "")
    return F.when(~bare.isin("", "-"), bare.try_cast("double"))


def half_up_score(x: Column, lo: int = 1, hi: int = 5) -> Column:
    """Rounded half up and clipped to a score range."""
    return F.least(F.greatest(F.floor(x + 0.5), F.lit(lo)), F.lit(hi)).cast("int")


def parsed_score(text: Column, lo: int = 1, hi: int = 5) -> Column:
    """A number in the range, else the first digit of the range in the text, else null."""
    value = text.try_cast("double")
    digit = F.regexp_extract(text, f"[{lo}-{hi}]", 0)
    return F.when(value.between(lo, hi), value.cast("int")).when(value.isNull() & (digit != ""), digit.cast("int"))


def alias(value: Column, names: dict[str, str]) -> Column:
    """The canonical name; unknown ones stay."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(table, value), value)


def banded(value: Column, cuts: list[float], labels: list[str]) -> Column:
    """labels[i] for values up to cuts[i], the last label beyond; null stays null."""
    out = F.lit(labels[-1])
    for c, label in reversed(list(zip(cuts, labels))):
        out = F.when(value <= c, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)


def display(value: Column) -> Column:
    """Text for reports: missing values become a dash."""
    return F.coalesce(value.cast("string"), F.lit("-"))


def anchor_block(fields: list[str]) -> Column:
    """``name=value; name=value`` over the fields in order."""
    return F.concat_ws("; ", *(F.concat(F.lit(f + "="), display(F.col(f))) for f in fields))


def token_set(text: Column) -> Column:
    """Distinct runs of Hangul syllables, ASCII letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[가-힣a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; two empty sets are alike."""
    common, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def set_text(items: Column) -> Column:
    """The different items in order, as one text."""
    return F.array_join(F.array_sort(F.array_distinct(items)), ",")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def ngrams(tokens: Column, n: int) -> Column:
    """Consecutive n-token strings; none if there are too few tokens."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.concat_ws(" ", F.slice(tokens, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def listed(text: Column) -> Column:
    """Items of a list written as text: brackets and quotes go, commas separate, blanks are dropped."""
    bare = F.regexp_replace(text, r"[\[\]'\"]", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != "")


def canonical(atom: Column, rules: list[tuple[str, str]]) -> Column:
    """The family of the first rule whose substring occurs, else the atom itself."""
    out = atom
    for part, family in reversed(rules):
        out = F.when(F.contains(atom, F.lit(part)), F.lit(family)).otherwise(out)
    return out


def masked(text: Column, terms: list[str], mask: str) -> Column:
    """All terms replaced, longest first."""
    import re

    pattern = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, pattern, mask) if pattern else text


def json_block(text: Column) -> Column:
    """The JSON object inside chat text: from a fenced block, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(braces != "", braces)


def sentences(text: Column) -> Column:
    """Loose split behind full stops, exclamation and question marks."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: x != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
