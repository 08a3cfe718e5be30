"""Prompt templates compiled to column expressions, their lint, and the assembly of prompts.

The language: ``{{ name }}``, ``{{ name | default("text") }}``, ``{{ "a" if name else "b" }}``, and blocks of ``{% if name %}``,
``{% else %}``, ``{% endif %}``; a dash inside the mark (``{%-``) strips white space on that side. Unknown names are errors at compile time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import context, spans

_MARK = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.S)
_NAME, _TEXT = r"[A-Za-z_]\w*", r"\"([^\"]*)\"|'([^']*)'"
# Words that mark a phrase as quoted, and how far around it they count.
SAFE_WORDS, BEFORE, AFTER = ["금지", "회피", "비사용", "지양"], 200, 80


class TemplateError(ValueError):
    """A template that can't be compiled."""


def names(template: str) -> set[str]:
    """The variables that a template uses."""
    found = set()
    for mark in _MARK.findall(template):
        found |= set(re.findall(_NAME, re.sub(_TEXT, "", mark))) - {"if", "else", "endif", "default"}
    return found


def _value(name: str, known: dict[str, Column]) -> Column:
    if name not in known:
        raise TemplateError(f"unknown variable: {name}")
    return known[name]


def _true(c: Column) -> Column:
    """Null, false, zero and the empty text are false."""
    return F.coalesce(~F.lower(c.cast("string")).isin("", "false", "0", "0.0"), F.lit(False))


def _printed(inner: str, known: dict[str, Column]) -> Column:
    if m := re.fullmatch(_NAME, inner):
        return F.coalesce(_value(inner, known).cast("string"), F.lit(""))
    if m := re.fullmatch(rf"({_NAME})\s*\|\s*default\((?:{_TEXT})\)", inner):
        return F.coalesce(known[m[1]].cast("string") if m[1] in known else F.lit(None), F.lit(m[2] if m[2] is not None else m[3]))
    if m := re.fullmatch(rf"(?:{_TEXT})\s+if\s+({_NAME})\s+else\s+(?:{_TEXT})", inner):
        yes, no = (m[1] if m[1] is not None else m[2]), (m[4] if m[4] is not None else m[5])
        return F.when(_true(_value(m[3], known)), F.lit(yes)).otherwise(F.lit(no))
    raise TemplateError(f"not understood: {inner}")


def compiled(template: str, known: dict[str, Column]) -> Column:
    """The template's text for a row, one expression."""
    parts = _MARK.split(template)
    for i in range(1, len(parts), 2):  # marks stand at odd places
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[Column, str]:
        nonlocal at
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if at % 2:
                out.append(F.lit(part))
                continue
            inner = part[2:-2].strip("-").strip()
            if part.startswith("{{"):
                out.append(_printed(inner, known))
            elif inner in ends:
                return F.concat(F.lit(""), *out), inner
            elif m := re.fullmatch(rf"if\s+({_NAME})", inner):
                condition = _true(_value(m[1], known))
                yes, end = block(("else", "endif"))
                no = block(("endif",))[0] if end == "else" else F.lit("")
                out.append(F.when(condition, yes).otherwise(no))
            else:
                raise TemplateError(f"not understood: {inner}")
        if ends:
            raise TemplateError(f"missing: {' or '.join(ends)}")
        return F.concat(F.lit(""), *out), ""

    return block(())[0]


def chosen(templates: dict[str, str], by: Column, known: dict[str, Column], fallback: str) -> Column:
    """The template of the row's own field, else the fallback; a template that is missing from both is an error."""
    if fallback not in templates:
        raise TemplateError(f"no template {fallback}")
    out = compiled(templates[fallback], known)
    for k, t in templates.items():
        if k != fallback:
            out = F.when(by == k, compiled(t, known)).otherwise(out)
    return out


def unsafe_phrases(text: Column, pattern: str) -> Column:
    """Matches that no safe word stands near to."""
    safe = "|".join(SAFE_WORDS)
    bad = F.filter(spans(text, pattern), lambda s: ~F.rlike(context(text, s["start"], F.length(s["match"]), BEFORE, AFTER), F.lit(safe)))
    return F.transform(bad, lambda s: s["match"])


def lint(templates, name: str, text: str, required: list[str], forbidden: str):
    """name, missing (required variables that no mark uses), unsafe (phrases), open_blocks (ifs without end)."""
    t = F.col(text)
    absent = [F.when(~F.rlike(t, F.lit(rf"\{{\{{-?\s*{v}\b|\{{%-?\s*if\s+{v}\b")), F.lit(v)) for v in required]
    opened = F.regexp_count(t, F.lit(r"\{%-?\s*if\b")) - F.regexp_count(t, F.lit(r"\{%-?\s*endif\b"))
    return templates.select(name, F.array_compact(F.array(*absent)).alias("missing"), unsafe_phrases(t, forbidden).alias("unsafe"), opened.alias("open_blocks"))


def assembled(sections: dict[str, Column]) -> Column:
    """Titled sections in order; empty ones are left out."""
    return F.concat_ws("\n\n", *(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), c)) for title, c in sections.items()))
