"""Corpus statistics: counters and term frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counters(df: DataFrame, names: list[str]) -> DataFrame:
    """name, value: a row for each counter of each page."""
    return df.select(F.expr(f"stack({len(names)}, {', '.join(f"'{n}', cast({n} as bigint)" for n in names)}) as (name, value)"))


def merged(counts: DataFrame, how: str) -> DataFrame:
    """Sum, min or max of each counter, with map-side partial aggregation."""
    return counts.groupBy("name").agg(getattr(F, how)("value").cast("long").alias("value"))


def term_counts(df: DataFrame, terms: str) -> DataFrame:
    """Each page or table counts once for each of its different terms."""
    return df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, group: str, terms: str, k: int = 50, stop=()) -> DataFrame:
    """The k most frequent terms of each group, ties by term; empty and stop words do not count.

    Terms are dropped after they are rows: a test of rows is compiled, one inside an array is not.
    """
    rows = df.select(group, F.explode(terms).alias("term")).where(~F.col("term").isin("", *stop))
    n = rows.groupBy(group, "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


def _hits(tokens, words: list[str]):
    """How many tokens are among the words."""
    known = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return F.size(F.filter(tokens, lambda t: F.array_contains(known, F.lower(t))))


def category(df: DataFrame, keywords: dict[str, list[str]], terms="terms") -> DataFrame:
    """The category with most keyword matches, the first of equals, '' if none matches."""
    scored = [
        F.struct(_hits(terms, ws).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name"))
        for i, (name, ws) in enumerate(keywords.items())
    ]
    best = F.array_max(F.array(*scored))
    return df.withColumn("category", F.when(best["n"] > 0, best["name"]).otherwise(""))


def keyword_class_counts(tokens, classes: dict[str, list[str]]):
    """struct of counts: each token counts for the first class that has it."""
    taken: list[str] = []
    fields = []
    for name, words in classes.items():
        fields.append(_hits(tokens, [w for w in words if w not in taken]).alias(name))
        taken += words
    return F.struct(*fields)
