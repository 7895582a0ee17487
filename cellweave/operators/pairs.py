"""Text mention x cell pairs: features, gold labels and bounded candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import quantity as Q
from cellweave.functions import similarity as S


def candidate_pairs(mentions: DataFrame, cells: DataFrame, on="doc_id") -> DataFrame:
    """Every mention with every cell of its document's tables: an equi-join on the document, never a cross join."""
    return mentions.join(cells, on)


def value_features(pairs: DataFrame) -> DataFrame:
    """Adds rel_max, rel_sum, rel_noscale, approx_sim and the values used.

    Needs x (scaled text value), x0 (unscaled), t, t0, unit (of the cell), inverse. A text value under
    1 against a percentage is taken times 100; an inverse that is closer, and not 0, replaces the cell.
    """
    df = pairs.withColumn("x", F.when((F.col("x") < 1) & F.col("unit").eqNullSafe(F.lit("%")), F.col("x") * 100).otherwise(F.col("x")))
    turn = F.coalesce((F.col("inverse") != 0) & (F.abs(F.col("x") - F.col("inverse")) < F.abs(F.col("x") - F.col("t"))), F.lit(False))
    df = df.withColumns({"t": F.when(turn, F.col("inverse")).otherwise(F.col("t")), "t0": F.when(turn, F.col("inverse")).otherwise(F.col("t0"))})
    d, d0 = F.abs(F.col("x") - F.col("t")), F.abs(F.col("x0") - F.col("t0"))
    return df.withColumns(
        {
            "rel_max": S.relative(d, F.greatest("x", "t")),
            "rel_sum": S.relative(d, F.col("x") + F.col("t")),
            "rel_noscale": S.relative(d0, F.greatest("x0", "t0")),
        }
    ).withColumn("approx_sim", F.greatest(1 - F.col("rel_max"), 1 - F.col("rel_noscale")))


def potential(rel: Column, surface: Column, overlap: Column) -> Column:
    return (rel <= 0.5) | (surface >= 0.3) | (overlap >= 0.1)


def normalised(pairs: DataFrame, column: str, by: list[str]) -> DataFrame:
    """A feature over its maximum for the mention, over all its pairs (a maximum of 0 counts as 1)."""
    most = F.max(column).over(Window.partitionBy(*by))
    return pairs.withColumn(column, F.col(column) / F.when(most == 0, 1.0).otherwise(most))


def top_k(pairs: DataFrame, k: int, by: list[str], score="sim", arrival="arrival", gold="gt", least: float | None = None) -> DataFrame:
    """At most k + 1 pairs a mention, gold ones always; of equal scores the later arrival stays."""
    if least is not None:
        pairs = pairs.where((F.col(score) >= least) | (F.col(gold) == 1))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(gold), F.desc(score), F.desc(arrival)))
    n_gold = F.sum(gold).over(Window.partitionBy(*by))
    return pairs.withColumns({"_r": rank, "_g": n_gold}).where((F.col("_r") <= F.greatest(F.lit(k + 1), F.col("_g")))).drop("_r", "_g")


def with_gold(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """gt = 1 where table, relation and sorted cells equal a gold row's."""
    key = gold.select("doc_id", "mx", "table_id", "func", Q.sorted_cells("cells").alias("cells")).distinct().withColumn("gt", F.lit(1))
    df = pairs.withColumn("cells", Q.sorted_cells("cells"))
    return df.join(key, ["doc_id", "mx", "table_id", "func", "cells"], "left").fillna({"gt": 0})


def first_gold(gold: DataFrame, by: list[str], seq="seq") -> DataFrame:
    """One gold row a mention: the first aggregate, else the first."""
    order = Window.partitionBy(*by).orderBy((F.col("func") == "same").cast("int"), seq)
    return gold.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def excluded_gold(pairs: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Pairs without the single cells of mentions whose chosen gold is an aggregate."""
    out = chosen.where("func != 'same'").select(*by).withColumn("func", F.lit("same"))
    return pairs.join(out, [*by, "func"], "left_anti")


def dummies(df: DataFrame, column="modifier") -> DataFrame:
    names = {"modapprox": "approx", "modbound": "bound", "modexact": "exact"}
    out = {n: F.col(column).eqNullSafe(F.lit(v)).cast("int") for n, v in names.items()}
    return df.withColumns(out | {"modNone": F.col(column).isNull().cast("int")})


def overlap_links(docs: DataFrame, tables: DataFrame, on: str, least: float = 0.2, most: int = 5) -> DataFrame:
    """Tables of a document by overlap, beyond ``least``, the best ``most``."""
    df = docs.join(tables, on).withColumn("overlap", S.overlap("doc_tokens", "table_tokens")).where(F.col("overlap") > least)
    best = F.row_number().over(Window.partitionBy(on, "doc_no").orderBy(F.desc("overlap"), "table_no"))
    return df.withColumn("rank", best).where(F.col("rank") <= most)


def matching_tables(mentions: DataFrame, tables: DataFrame, on: str, least: int = 2, strong: int = 4) -> DataFrame:
    """Of each mention's tables those with the largest word overlap; documents need one over ``strong`` or two exact ones."""
    df = mentions.join(tables, on).withColumn("n", S.set_overlap("words", "table_words")).where(F.col("n") >= least)
    best = F.max("n").over(Window.partitionBy(on, "mention_id"))
    df = df.withColumn("best", best).where("n = best")
    gate = F.max("n").over(Window.partitionBy(on))
    return df.withColumn("_g", gate).where(F.col("_g") > strong).drop("_g", "best")
