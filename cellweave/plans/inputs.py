"""Inputs derived from the given tables: quantity surfaces, numeric grids, priors and edges.

Each has a DataFrame form and, for the checks, the same definition as SQL (``SQL[name]``). All
arithmetic is on integer cents, so both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surfaces(spark, sf_dir) -> DataFrame:
    """id, cents, surface: quantities as they stand in texts, in eight notations."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return o.selectExpr(
        "id",
        "c as cents",
        """case id % 8
             when 0 then concat('$', c div 100000, '.', (c div 10000) % 10, 'k')
             when 1 then concat(c div 100, ' usd')
             when 2 then concat(c % 100, '%')
             when 3 then concat('$', c div 10000000, '.', lpad(cast((c div 100000) % 100 as string), 2, '0'), ' million')
             when 4 then concat('-', c div 100, '.', lpad(cast(c % 100 as string), 2, '0'))
             when 5 then concat(c div 100000, ',', lpad(cast((c div 100) % 1000 as string), 3, '0'))
             when 6 then concat(c % 100, ',', c % 10)
             else concat('about ', c div 100, ' euro') end as surface""",
    )


def grid(spark, sf_dir) -> DataFrame:
    """table_id, r, c, cell_id, cents, v, unit: revenue of nations by year, a table for each region."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    sums = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(cu, o.o_custkey == cu.c_custkey)
        .join(na, cu.c_nationkey == na.n_nationkey)
        .groupBy(F.col("n_regionkey").alias("table_id"), "n_nationkey", "y")
        .agg(F.sum("p").alias("cents"))
    )
    sums = sums.withColumns(
        {
            "r": F.dense_rank().over(Window.partitionBy("table_id").orderBy("n_nationkey")),
            "c": F.dense_rank().over(Window.partitionBy("table_id").orderBy("y")),
        }
    )
    return sums.select(
        "table_id",
        "r",
        "c",
        ((F.col("r") - 1) * 100 + F.col("c")).alias("cell_id"),
        "cents",
        (F.col("cents") / 100.0).alias("v"),
        F.when(F.col("r") % 3 == 0, None).otherwise("$").alias("unit"),
    )


def priors(spark, sf_dir) -> DataFrame:
    """mx, mt, func, prob, gt, pred: order lines as candidates of their order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("mx"),
        (F.col("l_linenumber") + 10 * F.col("l_partkey") + 10_000_000 * F.col("l_suppkey")).alias("mt"),
        F.expr("case l_linenumber % 5 when 0 then 'same' when 1 then 'sum' when 2 then 'dif' when 3 then 'rat' else 'percentage' end").alias("func"),
        ((F.round(F.col("l_discount") * 100).cast("long") + 1 + F.col("l_partkey") % 89) / 100.0).alias("prob"),
        (F.col("l_returnflag") == "R").cast("int").alias("gt"),
        F.expr("case l_orderkey % 5 when 0 then 'same' when 1 then 'sum' when 2 then 'dif' when 3 then 'rat' else 'percentage' end").alias("pred"),
        ((F.col("l_suppkey") % 11) / 10.0).alias("sim"),
    )


def edges(spark, sf_dir) -> DataFrame:
    """doc, src, dst, w: order lines (mentions) and their suppliers (cells) within a customer nation's week."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 97).alias("doc"),
        F.concat(F.lit("m"), (F.col("l_orderkey") % 7).cast("string")).alias("src"),
        F.concat(F.lit("t."), (F.col("l_suppkey") % 5).cast("string")).alias("dst"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"),
        F.col("l_quantity").cast("long").alias("q"),
    ).groupBy("doc", "src", "dst").agg(
        ((F.sum("d") + 1) / 100.0).alias("proximity"), (F.max("q") / 50.0).alias("surface_sim"), (F.min("q") / 50.0).alias("value_diff")
    )


SQL = {
    "surfaces": """surfaces AS (SELECT id, c AS cents, CASE id % 8
        WHEN 0 THEN '$' || (c // 100000) || '.' || ((c // 10000) % 10) || 'k'
        WHEN 1 THEN (c // 100) || ' usd'
        WHEN 2 THEN (c % 100) || '%'
        WHEN 3 THEN '$' || (c // 10000000) || '.' || lpad(CAST((c // 100000) % 100 AS VARCHAR), 2, '0') || ' million'
        WHEN 4 THEN '-' || (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
        WHEN 5 THEN (c // 100000) || ',' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0')
        WHEN 6 THEN (c % 100) || ',' || (c % 10)
        ELSE 'about ' || (c // 100) || ' euro' END AS surface
      FROM (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))""",
    "grid": """grid AS (SELECT table_id, r, c, CAST((r - 1) * 100 + c AS INT) AS cell_id, cents, cents / 100.0::DOUBLE AS v,
        CASE WHEN r % 3 = 0 THEN NULL ELSE '$' END AS unit FROM (
        SELECT table_id, CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY n) AS INT) AS r,
          CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY y) AS INT) AS c, cents
        FROM (SELECT n_regionkey AS table_id, n_nationkey AS n, year(o_orderdate) AS y,
                CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)))""",
    "priors": """priors AS (SELECT l_orderkey AS mx, l_linenumber + 10 * l_partkey + 10000000 * l_suppkey AS mt,
        CASE l_linenumber % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'sum' WHEN 2 THEN 'dif' WHEN 3 THEN 'rat' ELSE 'percentage' END AS func,
        (CAST(round(l_discount * 100) AS BIGINT) + 1 + l_partkey % 89) / 100.0::DOUBLE AS prob,
        CAST(l_returnflag = 'R' AS INT) AS gt,
        CASE l_orderkey % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'sum' WHEN 2 THEN 'dif' WHEN 3 THEN 'rat' ELSE 'percentage' END AS pred,
        (l_suppkey % 11) / 10.0::DOUBLE AS sim FROM lineitem)""",
    "edges": """edges AS (SELECT doc, src, dst, (sum(d) + 1) / 100.0::DOUBLE AS proximity, max(q) / 50.0::DOUBLE AS surface_sim,
        min(q) / 50.0::DOUBLE AS value_diff
      FROM (SELECT l_orderkey % 97 AS doc, 'm' || (l_orderkey % 7) AS src, 't.' || (l_suppkey % 5) AS dst,
              CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(l_quantity AS BIGINT) AS q
            FROM lineitem) GROUP BY doc, src, dst)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
