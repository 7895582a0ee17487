"""Pruning and ranking of scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import quantity as Q

LEAST_VALUE_SIM = 0.9


def pruned(pairs: DataFrame) -> DataFrame:
    """Pairs that the predicted class of their mention allows.

    Needs func, pred, second (the class ranked next), sim (the larger value similarity). Single cells
    always stay; another function stays if it is the predicted class, or, if that is 'same', the
    second or its near relation (a sum for a difference and back, a percentage for a ratio).
    """
    func, second = F.col("func"), F.col("second")
    near = (
        (func == second)
        | ((func == "dif") & (second == "sum"))
        | ((func == "sum") & (second == "dif"))
        | ((func == "percentage") & (second == "rat"))
    )
    keep = (func == "same") | F.when(F.col("pred") != "same", func == F.col("pred")).otherwise(near)
    return pairs.where((F.col("sim") >= LEAST_VALUE_SIM) & keep)


def top_priors(pairs: DataFrame, k: int, by="mx", score="prob", tie="mt") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def second_label(probabilities: dict[str, str]):
    """The best label, or the runner-up if the best is 'same'; ``probabilities``: label -> column. Ties by name."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(c)).alias("p"), F.lit(label).alias("label")) for label, c in sorted(probabilities.items())]))
    return F.when(ranked[0]["label"] == "same", ranked[1]["label"]).otherwise(ranked[0]["label"])


def mention_type(pairs: DataFrame, by="mx", score="prob", tie="mt") -> DataFrame:
    """Majority of the pair types of each mention's five best pairs; truncated unless another wins outright."""
    top = top_priors(pairs, 5, by, score, tie).withColumn("kind", Q.pair_type("mx_text", "mt_text"))
    n = {k: F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "approximate", "truncated")}
    df = top.groupBy(by).agg(*n.values())
    wins = lambda a, b, c: (F.col(a) > F.col(b)) & (F.col(a) > F.col(c))
    kind = F.when(wins("exact", "approximate", "truncated"), "exact").when(wins("approximate", "exact", "truncated"), "approximate").otherwise("truncated")
    return df.select(by, kind.alias("mention_type"))


def adaptive(pairs: DataFrame, by="mx", score="prob", tie="mt") -> DataFrame:
    """Best k pairs a mention: 5 if its type is exact, else 10 if the entropy of its scores is under 3, else 15."""
    whole = Window.partitionBy(by)
    p = F.col(score) / F.sum(score).over(whole)
    df = pairs.join(mention_type(pairs, by, score, tie), by).withColumn("_p", p)
    df = df.withColumn("entropy", -F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log("_p")).otherwise(0.0)).over(whole))
    df = df.withColumn("k", F.when(F.col("mention_type") == "exact", 5).when(F.col("entropy") < 3, 10).otherwise(15))
    rank = F.row_number().over(whole.orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).where("rank <= k").drop("_p")


def conflicts(pairs: DataFrame, by="mx", score="prob") -> DataFrame:
    """Pairs that are not gold and score above their mention's best gold pair."""
    gold = F.max(F.when(F.col("gt") == 1, F.col(score))).over(Window.partitionBy(by))
    return pairs.withColumn("gold_score", gold).where((F.col("gt") == 0) & (F.col(score) > F.col("gold_score")))


def mention_order(pairs: DataFrame, least: float, doc="doc", by="mx", score="prob") -> DataFrame:
    """Mentions of each document in the order they are resolved: fewest strong candidates, then highest best score."""
    df = pairs.groupBy(doc, by).agg(F.count_if(F.col(score) >= least).cast("long").alias("strong"), F.max(score).alias("best"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("strong", F.desc("best"), by)))
