"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are dealt by a hash into blocks of about ``BLOCK_WORDS`` words within their source. A
source whose target is ``c`` times its size and a rest takes every block ``c`` times, and for the
rest blocks in a permuted order until the words are reached. From the block where that is, on over
``FILL`` blocks, documents are taken in the same order as long as they fit, longer ones being passed
over, and one more if that is nearer: so a source misses its target by half the shortest document
passed over at most. That fixes, exactly, each source's quota of block draws. A binary tree over
the output shards splits the quotas: at each node the vector of quotas that goes left is drawn from
a multivariate hypergeometric distribution, seeded by the node. A leaf needs only its own path, so
leaves are computed independently, each giving the disjoint ranges of permuted draws that are its
shard's. Inside a shard documents are ordered by a hash.

The driver holds one row per source (``MAX_SOURCES`` at most, checked) and nothing per document or
block. Running totals over a source's blocks are taken in two levels of ``SPAN`` blocks.

Defined cases: null text has size 0; null source is a source, last in order; sources without words
have target 0; repeated rows are separate rows with equal draws; reruns agree, whatever the
partitioning; doc_ids may be integers or text; other columns, of any name, are ignored or passed on;
an empty table gives no rows; beyond ``MAX_SOURCES`` sources the query raises, as their targets are
shares of one whole that the driver computes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import free_names, own_columns, table, text_hash, written, ws_words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 4_000
#: Blocks from which the end of a source's draws is picked by document.
FILL = 12
SHARD_WORDS = 50_000_000
MIN_SHARDS = 8
SPAN = 1000
MAX_SOURCES = 100_000
SEED = 20_011


def targets(sizes: list[int], weights: list[int], most: int = MAX_REPEATS) -> list[float]:
    """Shares of the whole by weight, none above ``most`` times its size; the excess is reshared by weight."""
    total, capped = sum(sizes), [s == 0 for s in sizes]
    while True:
        rest = total - sum(most * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        out = [float(most * s) if c else rest * w / weight for s, w, c in zip(sizes, weights, capped)]
        above = [not c and t > most * s for t, s, c in zip(out, sizes, capped)]
        if not any(above):
            return out
        capped = [c or a for c, a in zip(capped, above)]


def _coprime(n: int, like: int) -> int:
    a = like % n or 1
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a


def splits(quotas: np.ndarray, shards: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """A leaf's quotas and where its ranges start, by the tree's path to it."""
    total, low, high = int(quotas.sum()), 0, shards
    own, start, node = quotas.astype(np.int64), np.zeros(len(quotas), np.int64), 1
    while high - low > 1:
        mid = (low + high) // 2
        room = total * mid // shards - total * low // shards
        left = np.random.default_rng([SEED, node]).multivariate_hypergeometric(own, room, method="marginals")
        if leaf < mid:
            own, high, node = left, mid, 2 * node
        else:
            start, own, low, node = start + left, own - left, mid, 2 * node + 1
    return own, start


def _leaves(quotas: list[int], shards: int):
    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = np.array(quotas, np.int64)
        for b in batches:
            for leaf in b["id"]:
                own, start = splits(q, shards, int(leaf))
                for i in np.flatnonzero(own):
                    yield pd.DataFrame({"i": int(i), "draw": np.arange(start[i], start[i] + own[i]), "shard": int(leaf)})

    return draws


def _filled(units: pd.DataFrame) -> pd.DataFrame:
    """Of one source's documents at the end of its draws, those that are taken: at most FILL blocks' documents."""
    units = units.sort_values(["place", "o"])
    room = int(units["left_over"].iloc[0])
    taken, shortest = [], None
    for o, n in zip(units["o"], units["unit"]):
        if n <= room:
            room -= n
            taken.append(o)
        elif shortest is None or n < shortest[0]:
            shortest = n, o
    if shortest and 2 * room > shortest[0]:
        taken.append(shortest[1])
    return pd.DataFrame({"i": np.full(len(taken), units["i"].iloc[0], np.int32), "o": np.array(taken, np.int64)})


def _order(salt: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(SEED + salt), *cols)


def mix(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, th, size, source_size, target, copies, draws (copy, shard).

    ``copies`` is how often the mix takes the document; ``draws`` lists the shard of each.
    """
    spark = docs.sparkSession
    sized = written(
        docs.select("doc_id", text_hash().alias("th"), "source", F.size(ws_words(F.col("text"))).cast("long").alias("size")),
        "sized",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r.s for r in totals], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))]) if totals else []
    plan = []
    for i, (r, t) in enumerate(zip(totals, wanted)):
        full = min(MAX_REPEATS, int(t // r.s)) if r.s else 0
        n = max(1, -(-r.s // BLOCK_WORDS))
        rest = int(round(t - full * r.s)) if full < MAX_REPEATS else 0
        plan.append((r.source, i, r.s, t, n, full, rest, _coprime(n, (2 * SEED + 1 + 7919 * i) * 2654435761 % 2**31), 104729 * (i + 1) % n))
    per = spark.createDataFrame(plan, "source string, i int, source_size long, target double, n long, full int, rest long, a long, b long")
    per = F.broadcast(per)  # MAX_SOURCES rows at most
    rows = sized.join(per, sized.source.eqNullSafe(per.source)).drop(per.source).withColumn(
        "block", F.pmod(_order(0, "doc_id", "th"), F.col("n"))
    )
    # A block's place in copy c of its source is a permutation of the blocks that differs by copy.
    place = lambda c: F.pmod(F.col("a") * F.col("block") + F.col("b") * (c + 1) + c, F.col("n"))
    blocks = rows.groupBy("i", "block", "n", "full", "rest", "a", "b").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("place", place(F.col("full"))).withColumn("span", F.floor(F.col("place") / SPAN))
    inside = Window.partitionBy("i", "span").orderBy("place")
    spans = blocks.groupBy("i", "span").agg(F.sum("words").alias("w"))
    spans = spans.select("i", "span", (F.sum("w").over(Window.partitionBy("i").orderBy("span")) - F.col("w")).alias("head"))
    blocks = written(
        blocks.withColumn("own", F.sum("words").over(inside) - F.col("words"))
        .join(spans, ["i", "span"])
        .withColumn("before", F.col("head") + F.col("own"))
        .drop("head", "own", "span"),
        "blocks",
    )
    # The block where the rest ends, one a source; none if it ends with the last.
    edges = written(
        blocks.where("rest > 0 and words > 0 and before < rest and rest <= before + words").select("i", F.col("place").alias("edge"), (F.col("rest") - F.col("before")).alias("left_over")),
        "edges",
    )
    ends = {r.i: r.edge for r in edges.collect()}
    quota = [p[5] * p[4] + (min(p[4], ends[p[1]] + FILL) if p[1] in ends else 0) for p in plan]
    shards = max(MIN_SHARDS, -(-sum(r.s for r in totals) // SHARD_WORDS))
    leaves = spark.range(shards).mapInPandas(_leaves(quota, shards), "i int, draw long, shard int")
    copies = blocks.select("i", "block", "n", "a", "b", F.explode(F.expr("sequence(0, full)")).alias("copy"))
    copies = copies.withColumn("draw", F.col("copy") * F.col("n") + place(F.col("copy")))
    drawn = copies.join(leaves, ["i", "draw"]).groupBy("i", "block").agg(
        F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("draws")
    )
    drawn = blocks.select("i", "block", "place").join(drawn, ["i", "block"], "left")
    # MAX_SOURCES rows of edges at most.
    out = rows.join(drawn, ["i", "block"], "left").join(F.broadcast(edges), "i", "left").withColumn("o", _order(1, "doc_id", "th"))
    inside = F.coalesce((F.col("place") >= F.col("edge")) & (F.col("place") < F.col("edge") + FILL), F.lit(False))
    part = out.where(inside)
    units = part.where("size > 0").groupBy("i", "place", "o", "left_over").agg(F.sum("size").alias("unit"))
    taken = units.groupBy("i").applyInPandas(_filled, "i int, o long").withColumn("fits", F.lit(True))
    part = part.join(taken, ["i", "o"], "left").withColumn("draws", F.expr("filter(draws, x -> x.copy < full or coalesce(fits, false))"))
    out = out.where(~inside).unionByName(part.drop("fits"))
    none = F.array().cast("array<struct<copy:int,shard:int>>")
    return out.select(
        "doc_id", "th", "size", "source_size", "target", F.coalesce("draws", none).alias("draws")
    ).withColumn("copies", F.size("draws"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.array_join(F.col("draws.shard").cast("array<string>"), ",").alias("shards"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each taken copy, with the columns of ``docs``, its shard and its place there."""
    # Repeated rows share their draws.
    d, t, own, x = free_names(docs, 4)
    marks = mix(docs).where("copies > 0").select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("draws").alias(x)).dropDuplicates([d, t])
    out = docs.withColumn(own, text_hash()).join(marks, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(t)))
    out = out.select(*own_columns(docs), F.col(own), F.explode(x).alias(x))
    # A column of these names is replaced.
    more = {"mix_copy": F.col(f"{x}.copy"), "mix_shard": F.col(f"{x}.shard"), "mix_place": F.xxhash64(F.lit(SEED + 2), f"{x}.copy", "doc_id", own)}
    out = out.select("*", *[c.alias(f"{x}{k}") for k, c in more.items()])
    return out.select(*[c for n, c in zip(docs.columns, own_columns(docs)) if n.lower() not in more], *[F.col(f"{x}{k}").alias(k) for k in more])
