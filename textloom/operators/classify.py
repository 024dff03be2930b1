"""Ordered regex rules as one generated CASE expression, and category counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions import text as T


def first_match(c: Column, table: list[tuple[str, str]]) -> Column:
    """Category of the first rule that matches, or null."""
    own = T.text_or_empty(c)
    return F.coalesce(*[F.when(own.rlike(T.pattern(p, "i")), name) for name, p in table])


def category(url: Column, title: Column, content: Column) -> Column:
    """By url, then title, then the first characters of the content."""
    head = F.substring(content, 1, rules.CLASSIFIED_CHARS)
    return F.coalesce(first_match(url, rules.URL_CATEGORIES), first_match(title, rules.URL_CATEGORIES), first_match(head, rules.CONTENT_CATEGORIES), F.lit(rules.DEFAULT_CATEGORY))


def counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")
