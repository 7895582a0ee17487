"""Graphs of mentions and cells: edges, weights, personalised walks and joint resolution.

A node id with a dot is a cell, without one a text mention. Documents are graphs of their own; every
operator is keyed by document, so a corpus is many small graphs in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import similarity as S

DAMPING = 0.85


def exact_sum(c: Column) -> Column:
    """Sum of doubles taken at 12 decimals, so that it does not depend on their order."""
    return F.sum(c.cast("decimal(26,12)")).cast("double")


def text_edges(mentions: DataFrame) -> DataFrame:
    """Pairs of a document's mentions: proximity 5 / gap and mean relative difference. Equal offsets give no edge."""
    a, b = mentions.alias("a"), mentions.alias("b")
    df = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.seq") < F.col("b.seq")))
    gap = F.abs(F.col("a.start") - F.col("b.start"))
    rel = lambda x: S.relative(F.abs(F.col(f"a.{x}") - F.col(f"b.{x}")), F.greatest(F.col(f"a.{x}"), F.col(f"b.{x}")))
    return df.where(gap > 0).select(
        F.col("a.doc").alias("doc"),
        F.col("a.seq").alias("src"),
        F.col("b.seq").alias("dst"),
        (F.lit(5.0) / gap).alias("proximity"),
        ((rel("value") + rel("raw")) / 2).alias("value_diff"),
    )


def cell_distance(r1, c1, r2, c2) -> Column:
    return F.when(r1 == r2, F.abs(c1 - c2)).when(c1 == c2, F.abs(r1 - r2)).otherwise(0)


def cell_edges(cells: DataFrame, weight: float = 0.1) -> DataFrame:
    """Pairs of a table's cells in one row or one column, by two equi-joins."""
    cols = ["table_id", "cell_id", "r", "c", "v"]
    a = cells.select(*[F.col(x).alias(f"a_{x}") for x in cols])
    b = cells.select(*[F.col(x).alias(f"b_{x}") for x in cols])
    table = F.col("a_table_id") == F.col("b_table_id")
    later = F.col("a_cell_id") < F.col("b_cell_id")
    same_row = a.join(b, table & (F.col("a_r") == F.col("b_r")) & later)
    same_col = a.join(b, table & (F.col("a_c") == F.col("b_c")) & (F.col("a_r") != F.col("b_r")) & later)
    return same_row.unionByName(same_col).select(
        F.col("a_table_id").alias("table_id"),
        F.col("a_cell_id").alias("src"),
        F.col("b_cell_id").alias("dst"),
        cell_distance(F.col("a_r"), F.col("a_c"), F.col("b_r"), F.col("b_c")).alias("distance"),
        F.lit(weight).alias("proximity"),
        S.relative(F.abs(F.col("a_v") - F.col("b_v")), F.greatest("a_v", "b_v")).alias("value_diff"),
    )


def source_edges(virtual: DataFrame, weight: float = 0.1) -> DataFrame:
    """Each virtual cell with each of its source cells."""
    return virtual.select("table_id", F.concat_ws(".", "key", "func").alias("src"), F.explode(F.split("key", ",").cast("array<int>")).alias("dst"), F.lit(weight).alias("proximity"))


def graph(edges: DataFrame, priors: DataFrame, lambda1: float = 0.9, both_ways: bool = False) -> DataFrame:
    """doc, src, dst, w: undirected weighted edges, and prior edges from mention to cell. A later edge replaces an earlier one."""
    w = lambda1 * F.col("proximity") + (1 - lambda1) * F.col("surface_sim")
    out = edges.select("doc", "src", "dst", w.alias("w"), F.lit(0).alias("seq"))
    back = edges.select("doc", F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("w"), F.lit(1).alias("seq"))
    prior = priors.select("doc", "src", "dst", F.col("prob").alias("w"), F.lit(2).alias("seq"))
    every = out.unionByName(back).unionByName(prior)
    if both_ways:
        every = every.unionByName(priors.select("doc", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("prob").alias("w"), F.lit(3).alias("seq")))
    return every.groupBy("doc", "src", "dst").agg(F.max_by("w", F.struct("seq", "w")).alias("w"))


def ablation_weight(surface: Column, value: Column, context: Column, without: str | None = None, least: float = 0.7) -> Column:
    """Blend of features, 0 below ``least``; leaving one out shares the rest equally."""
    parts = {"surface": (surface, 0.4), "value": (value, 0.3), "context": (context, 0.3)}
    if without:
        parts = {k: (c, 0.5) for k, (c, _) in parts.items() if k != without}
    (c0, w0), *rest = parts.values()
    blend = c0 * w0
    for c, w in rest:
        blend = blend + c * w
    return F.when(blend < least, 0.0).otherwise(blend)


def stochastic(g: DataFrame) -> DataFrame:
    """Out-weights of each node made to sum to 1."""
    total = F.sum(F.col("w").cast("decimal(26,12)")).over(Window.partitionBy("doc", "src")).cast("double")
    return g.withColumn("w", F.col("w") / total)


def walk(g: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """doc, seed, node, mass after a fixed number of steps of a walk that restarts at its seed.

    ``g`` is stochastic; ``seeds``: doc, seed. Dangling mass restarts too. All documents and seeds
    advance together, one join and one aggregation a step.
    """
    here = seeds.select("doc", "seed", F.col("seed").alias("node"), F.lit(1.0).alias("mass"))
    outs = g.select("doc", F.col("src").alias("node"), "dst", "w")
    for _ in range(steps):
        moved = here.join(outs, ["doc", "node"]).groupBy("doc", "seed", F.col("dst").alias("node")).agg((DAMPING * exact_sum(F.col("mass") * F.col("w"))).alias("mass"))
        kept = moved.groupBy("doc", "seed").agg(exact_sum(F.col("mass")).alias("kept"))
        home = seeds.join(kept, ["doc", "seed"], "left").select(
            "doc", "seed", F.col("seed").alias("node"), (1 - F.coalesce("kept", F.lit(0.0))).alias("mass")
        )
        here = moved.unionByName(home).groupBy("doc", "seed", "node").agg(exact_sum(F.col("mass")).alias("mass"))
    return here


def rescaled(masses: DataFrame, by: list[str], column="mass") -> DataFrame:
    """Masses over their sum, by mention; all 0 stays 0."""
    total = F.sum(F.col(column).cast("decimal(26,12)")).over(Window.partitionBy(*by)).cast("double")
    return masses.withColumn(column, F.coalesce(F.try_divide(F.col(column), total), F.lit(0.0)))


def without_candidates(g: DataFrame, mentions: DataFrame) -> DataFrame:
    """The graph without edges from the given mentions to cells."""
    m = mentions.select("doc", F.col("seed").alias("src")).withColumn("_m", F.lit(True))
    return g.join(m, ["doc", "src"], "left").where(~(F.col("_m").isNotNull() & F.contains("dst", F.lit(".")))).drop("_m")


def pagerank(weights: np.ndarray, seed: int, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Personalised PageRank of one small graph by power iteration; rows are normalised, dangling mass restarts."""
    n = len(weights)
    out = weights.sum(axis=1, keepdims=True)
    move = np.divide(weights, out, out=np.zeros_like(weights), where=out > 0)
    dangling = (out[:, 0] == 0).astype(float)
    home = np.zeros(n)
    home[seed] = 1.0
    x = np.full(n, 1.0 / n)
    for _ in range(rounds):
        new = DAMPING * (x @ move + (x @ dangling) * home) + (1 - DAMPING) * home
        if np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    return x


def resolve_document(edges: pd.DataFrame, priors: pd.DataFrame, alpha=0.6, threshold=0.5, rounds=100, tolerance=1e-6, remove_before=True) -> pd.DataFrame:
    """Greedy joint resolution of one document: mentions in order of certainty, each decision an edge for the next."""
    nodes = sorted({*edges["src"], *edges["dst"], *priors["src"], *priors["dst"]})
    at = {x: i for i, x in enumerate(nodes)}
    g = np.zeros((len(nodes), len(nodes)))
    for s, d, w in zip(edges["src"], edges["dst"], edges["w"]):
        g[at[s], at[d]] = w
    for s, d, p in zip(priors["src"], priors["dst"], priors["prob"]):
        g[at[s], at[d]] = p
    sums = g.sum(axis=1, keepdims=True)
    g = np.divide(g, sums, out=np.zeros_like(g), where=sums > 0)
    groups = {m: c.sort_values("dst") for m, c in priors.groupby("src")}
    order = sorted(groups, key=lambda m: (int((groups[m]["prob"] >= threshold).sum()), -groups[m]["prob"].max(), m))
    found = []
    for m in order:
        cand = groups[m]
        cells = cand["dst"].tolist()
        if len(cells) == 1:
            winner, score = cells[0], float(cand["prob"].iloc[0])
        else:
            if remove_before:
                g[at[m], [at[c] for c in cells]] = 0
            mass = pagerank(g, at[m], rounds, tolerance)[[at[c] for c in cells]]
            mass = mass / mass.sum() if mass.sum() > 0 else mass
            g[at[m], [at[c] for c in cells]] = 0
            scores = alpha * mass + (1 - alpha) * cand["prob"].to_numpy()
            best = int(np.argmax(scores))
            winner, score = (cells[best], float(scores[best])) if scores[best] >= threshold else (None, float(scores[best]))
        if winner is not None:
            g[at[m], at[winner]] = g[at[winner], at[m]] = score
        found.append((m, winner, score))
    return pd.DataFrame(found, columns=["mention", "cell", "score"])


def resolve(edges: DataFrame, priors: DataFrame, **options) -> DataFrame:
    """doc, mention, cell, score for every mention with priors; documents without edges resolve by priors.

    Within a document decisions depend on each other, so a document is one group; a document's
    mentions and cells are bounded by its page's size.
    """

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame({"doc": [], "mention": [], "cell": [], "score": []})
        out = resolve_document(left, right, **options)
        out.insert(0, "doc", key[0])
        return out

    kind = priors.schema["doc"].dataType.simpleString()
    return (
        edges.select("doc", "src", "dst", "w")
        .groupBy("doc")
        .cogroup(priors.select("doc", "src", "dst", "prob").groupBy("doc"))
        .applyInPandas(solve, f"doc {kind}, mention string, cell string, score double")
    )


def parameter_grid(spark, alphas=11, thresholds=6, lambdas=11) -> DataFrame:
    """alpha, beta = 1 - alpha, threshold, lambda1, lambda2 = 1 - lambda1, in tenths."""
    n = F.col("id")
    df = spark.range(alphas * thresholds * lambdas).select(
        (F.floor(n / (thresholds * lambdas)) / 10.0).alias("alpha"),
        (F.floor(n / lambdas) % thresholds / 10.0).alias("threshold"),
        (n % lambdas / 10.0).alias("lambda1"),
    )
    return df.withColumns({"beta": (10 - F.col("alpha") * 10) / 10.0, "lambda2": (10 - F.col("lambda1") * 10) / 10.0})
