"""Confusion counts, metrics and recall of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(predicted: Column, gold: Column) -> Column:
    return F.when(predicted & (gold == 1), "tp").when(predicted, "fp").when(gold == 1, "fn").otherwise("tn")


def confusion(df: DataFrame, relation="func") -> DataFrame:
    """tp, fp, tn, fn by relation, with a row 'all'; one pass by grouping sets."""
    counts = [F.count_if(F.col("outcome") == k).cast("long").alias(k) for k in ("tp", "fp", "tn", "fn")]
    return df.rollup(relation).agg(*counts, F.grouping(relation).alias("g")).withColumn(relation, F.when(F.col("g") == 1, "all").otherwise(F.col(relation))).drop("g")


def metrics(df: DataFrame) -> DataFrame:
    """Sensitivity, specificity, accuracy, balanced accuracy, precision and F1 from counts; 0 where undefined."""
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    df = df.withColumns({"sensitivity": part(tp, tp + fn), "specificity": part(tn, tn + fp), "precision": part(tp, tp + fp), "accuracy": part(tp + tn, tp + fp + tn + fn)})
    return df.withColumns(
        {
            "balanced": (F.col("sensitivity") + F.col("specificity")) / 2,
            "f1": part(2 * F.col("precision") * F.col("sensitivity"), F.col("precision") + F.col("sensitivity")),
        }
    )


def kappa(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return df.withColumn("kappa", F.coalesce(F.try_divide((tp + tn) / n - chance, 1 - chance), F.lit(0.0)))


def top1(pairs: DataFrame, least: float = 0.5, by="mx", score="prob", tie="mt") -> DataFrame:
    """Outcome of the baseline: a mention's best pair is positive if it reaches ``least``, all others negative."""
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)) == 1
    return pairs.withColumn("outcome", outcome(first & (F.col(score) >= least), F.col("gt")))


def case_matrix(df: DataFrame) -> DataFrame:
    """Counts by relation: all, positive, negative, and the same for equal values, with misses and false alarms."""
    pos, neg, eq = F.col("gt") == 1, F.col("gt") == 0, F.col("equal")
    miss, alarm = pos & (F.col("prob") < 0.5), neg & (F.col("prob") > 0.5)
    cases = {"total": F.lit(True), "pos": pos, "neg": neg, "eq_total": eq, "eq_pos": eq & pos, "eq_neg": eq & neg, "fn": miss, "fp": alarm, "eq_fn": eq & miss, "eq_fp": eq & alarm}
    return df.groupBy("func").agg(*[F.count_if(c).cast("long").alias(n) for n, c in cases.items()])


def recall(df: DataFrame) -> DataFrame:
    """Kept and dropped gold pairs by relation, and their recall; ``kept`` is a boolean column."""
    counts = df.where("gt = 1").groupBy("func").agg(F.count_if("kept").cast("long").alias("n_kept"), F.count_if(~F.col("kept")).cast("long").alias("n_dropped"))
    return counts.withColumn("recall", F.col("n_kept").cast("double") / (F.col("n_kept") + F.col("n_dropped")))


def rank_recall(df: DataFrame, features: list[str], k: int, by="mx", tie="mt") -> DataFrame:
    """Of each feature, how many gold pairs are beyond rank k of their mention."""
    long = df.select(by, tie, "gt", F.expr(f"stack({len(features)}, {', '.join(f"'{f}', {f}" for f in features)}) as (feature, x)"))
    rank = F.row_number().over(Window.partitionBy(by, "feature").orderBy(F.desc("x"), tie))
    return long.withColumn("rank", rank).groupBy("feature").agg(F.count_if((F.col("gt") == 1) & (F.col("rank") > k)).cast("long").alias("missed"))


def auc(df: DataFrame, score="score", label="label") -> DataFrame:
    """Area under the curve by rank sums over the different scores.

    Scores are cut into about 200 ranges, so running totals are taken inside a range and over the
    ranges, and no window holds all scores.
    """
    by = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    cuts = by.agg(F.percentile_approx(score, [i / 200 for i in range(1, 200)], 10_000).alias("cuts"))
    by = by.join(F.broadcast(cuts), F.lit(True)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(score)))).drop("cuts")
    own = F.sum("n").over(Window.partitionBy("range").orderBy(score)) - F.col("n")
    ranges = by.groupBy("range").agg(F.sum("n").alias("all"))
    ranges = ranges.select("range", (F.sum("all").over(Window.orderBy("range")) - F.col("all")).alias("head"))
    by = by.withColumn("own", own).join(F.broadcast(ranges), "range").withColumn("below", F.col("own") + F.col("head"))
    sums = by.agg(F.sum(F.col("p") * (2 * F.col("below") + F.col("n"))).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select((F.col("s").cast("double") / (2 * F.col("p") * F.col("n"))).alias("auc"))
