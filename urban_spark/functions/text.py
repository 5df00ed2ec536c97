"""Text and number coercion as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Numbers written with commas and blanks; null where it is none."""
    return F.regexp_replace(F.trim(text.cast("string")), "[, ]", "").try_cast("double")


def measurement(text: Column) -> Column:
    """The first number of a measurement with a unit, such as "12.5 m"."""
    return F.nullif(F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def number_between(text: Column, low: int, high: int) -> Column:
    """The first whole number of a text within the bounds."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.get(F.filter(found, lambda x: x.between(low, high)), F.lit(0))


def fields(text: Column, patterns: dict[str, list[str]]) -> list[Column]:
    """One column for each name: the first group of the first of its patterns that matches."""
    one = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return [F.coalesce(*(one(p) for p in ps), F.lit(None).cast("string")).alias(name) for name, ps in patterns.items()]


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]*>", ""))


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(normalized(text), " ")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0..100: the best edit-distance ratio among the shared words and these with either text's others."""
    shared = F.array_join(F.array_intersect(token_set(a), token_set(b)), " ")
    with_rest = lambda x, y: F.trim(F.concat_ws(" ", shared, F.array_join(F.array_except(token_set(x), token_set(y)), " ")))
    ratio = lambda x, y: F.when(F.length(x) + F.length(y) == 0, 0.0).otherwise(100.0 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))))
    one, two = with_rest(a, b), with_rest(b, a)
    return F.greatest(F.when(shared != "", F.greatest(ratio(shared, one), ratio(shared, two))).otherwise(0.0), ratio(one, two))


def by_keywords(columns: list[str], keywords: list[str]) -> str | None:
    """The first column whose name holds a keyword, keywords in turn."""
    return next((c for k in keywords for c in columns if k in c.lower()), None)
