"""Ranked text search with lines of context, exclusion filters, suggestions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term, without case."""
    low, term = F.lower(text), term.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("long")


def help_search(docs: DataFrame, terms: list[str], top: int | None = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lines, found, hits): documents with any term, their lines around it,
    best first: by distinct terms, hits, then lines kept.

    Lines are gone through in order. Where the next line has a term, this one,
    the next and the one after are kept; else where this one has, it and the
    next; the scan goes on behind what was kept. Gaps become one null line.
    """
    has = lambda c: F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(c), t))
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  else a lambda would work it out for each element

    def around(lines: Column) -> Column:
        # one letter a line; the expression takes it from left to right as the rule says
        marks = F.array_join(F.transform(lines, lambda x: F.when(has(x), "1").otherwise("0")), "")
        taken = F.transform(F.regexp_extract_all(marks, F.lit("([01]1[01]?|1[01]?|0)"), F.lit(1)), lambda t: F.repeat(F.when(t.contains("1"), "k").otherwise("-"), F.length(t)))
        told = F.split(F.array_join(taken, ""), "")
        gap = F.array(F.lit(None).cast("string"))
        piece = lambda keep, k, i: F.when((i > 0) & (F.get(keep, i - 1) < k - 1), F.concat(gap, F.array(F.get(lines, k)))).otherwise(F.array(F.get(lines, k)))
        kept = lambda told: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: F.get(told, k) == "k")
        return once(once(told, kept), lambda keep: F.flatten(F.transform(keep, lambda k, i: piece(keep, k, i))))

    rows = docs.select(id_col, F.col(text_col).alias("_text")).where(has(F.col("_text")))
    rows = rows.select(id_col, once(F.split("_text", "\n+"), around).alias("lines"))
    counts = [F.aggregate("lines", F.lit(0).cast("long"), _adder(t)) for t in terms]
    rows = rows.withColumn("_counts", F.array(*counts))
    rows = rows.select(id_col, "lines", F.size(F.filter("_counts", lambda c: c > 0)).alias("found"), F.aggregate("_counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("hits"))
    ranked = rows.orderBy(F.desc("found"), F.desc("hits"), F.desc(F.size("lines")), id_col)
    return ranked if top is None else ranked.limit(top)


def _adder(term: str):
    return lambda total, line: total + F.coalesce(occurrences(line, term), F.lit(0).cast("long"))


def excluded(words: Column, patterns: list[str]) -> Column:
    """Whether lower-case words hold any pattern; /pattern/ is an expression."""
    out = F.lit(False)
    for p in patterns:
        if p.startswith("/"):
            out = out | words.rlike(re.sub("/$", "", p)[1:])
        else:
            out = out | words.contains(p)
    return out


def search_words(name: Column, maintainers: Column, keywords: Column) -> Column:
    parts = F.filter(F.transform(F.concat(F.array(name), F.coalesce(maintainers, F.array().cast("array<string>")), F.coalesce(keywords, F.array().cast("array<string>"))), F.trim), lambda w: w != "")
    return F.lower(F.array_join(parts, " "))


def suggestions(names: DataFrame, typed: str, top: int | None = 3) -> DataFrame:
    """(name, distance): names nearer than four tenths of the typed word's length."""
    near = names.select("name").distinct().withColumn("distance", F.levenshtein(F.lit(typed), F.col("name"))).where((F.col("distance") < 0.4 * len(typed)) & (F.col("name") != typed)).orderBy("distance", "name")
    return near if top is None else near.limit(top)
