"""Virtual cells: values computed from the cells of a row or a column.

Input: table_id, r, c, cell_id, v (signed), unit, and optionally aggregate (the last cell's header
names an aggregate). A vector is a row or column; subsets are the vector, the vector without an
aggregate last cell (if it has over four), and all pairs of one unit. A subset met twice counts
once, rows before columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.quantity import round2

LEAST_FOR_SUBSET = 4


def vectors(cells: DataFrame) -> DataFrame:
    """table_id, axis, line, items (in order, neighbours of one spanning cell once), aggregate."""
    has = "aggregate" in cells.columns
    base = cells if has else cells.withColumn("aggregate", F.lit(False))
    rows = base.select("table_id", F.lit("row").alias("axis"), F.col("r").alias("line"), F.col("c").alias("pos"), "cell_id", "v", "unit", "aggregate")
    cols = base.select("table_id", F.lit("col").alias("axis"), F.col("c").alias("line"), F.col("r").alias("pos"), "cell_id", "v", "unit", "aggregate")
    both = rows.unionByName(cols)
    before = F.lag("cell_id").over(Window.partitionBy("table_id", "axis", "line").orderBy("pos"))
    both = both.withColumn("again", before.eqNullSafe(F.col("cell_id"))).where("not again")
    item = F.struct("pos", "cell_id", "v", "unit", "aggregate")
    return (
        both.groupBy("table_id", "axis", "line")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .where(F.size("items") > 1)
        .withColumn("aggregate", F.element_at("items", -1)["aggregate"])
    )


def pairs(cells: DataFrame) -> DataFrame:
    """table_id, axis, line, a, b: pairs of a vector's cells of one unit, or both of none."""
    v = vectors(cells).select("table_id", "axis", "line", F.posexplode("items").alias("i", "a"), "items")
    # Each cell meets only the later ones of its own vector.
    v = v.select("table_id", "axis", "line", "a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("b"))
    return v.where(F.col("a.unit").eqNullSafe(F.col("b.unit")))


def subsets(cells: DataFrame) -> DataFrame:
    """table_id, key, items, kind: the different subsets, each where it is first met."""
    v = vectors(cells)
    whole = v.select("table_id", "axis", "line", "items", F.lit(0).alias("kind"))
    rest = v.where((F.size("items") > LEAST_FOR_SUBSET) & F.col("aggregate")).select(
        "table_id", "axis", "line", F.expr("slice(items, 1, size(items) - 1)").alias("items"), F.lit(1).alias("kind")
    )
    two = pairs(cells).select("table_id", "axis", "line", F.array("a", "b").alias("items"), F.lit(2).alias("kind"))
    every = whole.unionByName(rest).unionByName(two).withColumn(
        "key", F.array_join(F.transform("items", lambda x: x["cell_id"].cast("string")), ",")
    )
    first = Window.partitionBy("table_id", "key").orderBy(F.desc("axis"), "line", "kind")
    return every.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def sum_and_average(sets: DataFrame) -> DataFrame:
    """Absolute sum of the values that have the first one's unit, and that over the number of all; none where the sum is 0."""
    total = F.expr("aggregate(items, 0D, (s, x) -> s + if(x.unit <=> items[0].unit, x.v, 0D))")
    out = sets.withColumn("total", F.abs(total)).where("total != 0")
    return out.select("table_id", "key", F.col("total").alias("sum"), (F.col("total") / F.size("items")).alias("avg"))


def _two(sets: DataFrame) -> DataFrame:
    return sets.where(F.size("items") == 2).select(
        "table_id", "key", F.expr("items[0].v").alias("a"), F.expr("items[1].v").alias("b"), F.expr("items[0].unit").alias("unit")
    ).where("a != 0 and b != 0")


def differences(sets: DataFrame) -> DataFrame:
    return _two(sets).select("table_id", "key", F.abs(F.col("a") - F.col("b")).alias("value"), (F.col("b") - F.col("a")).alias("inverse"))


def change_ratios(sets: DataFrame) -> DataFrame:
    two = _two(sets).where("not unit <=> '%'")
    ratio = lambda a, b: F.abs(round2(100 * F.abs(F.col(a) - F.col(b)) / F.col(b)))
    return two.select("table_id", "key", ratio("a", "b").alias("value"), ratio("b", "a").alias("inverse"), F.lit("%").alias("unit"))


def percentages(sets: DataFrame) -> DataFrame:
    two = _two(sets).where("not unit <=> '%'")
    return two.select(
        "table_id",
        "key",
        F.abs(round2(100 * F.col("a") / F.col("b"))).alias("value"),
        round2(100 * F.col("b") / F.col("a")).alias("inverse"),
        F.lit("%").alias("unit"),
    )


def virtual_cells(cells: DataFrame) -> DataFrame:
    """table_id, key, func, value, inverse, unit of every virtual cell."""
    sets = subsets(cells)
    sums = sum_and_average(sets).join(sets.select("table_id", "key", F.expr("items[0].unit").alias("unit")), ["table_id", "key"])
    none = F.lit(None).cast("double")
    two = sets.select("table_id", "key", F.expr("items[0].unit").alias("unit"))
    parts = [
        sums.select("table_id", "key", F.lit("sum").alias("func"), F.col("sum").alias("value"), none.alias("inverse"), "unit"),
        sums.select("table_id", "key", F.lit("avg").alias("func"), F.col("avg").alias("value"), none.alias("inverse"), "unit"),
        differences(sets).join(two, ["table_id", "key"]).select("table_id", "key", F.lit("dif").alias("func"), "value", "inverse", "unit"),
        change_ratios(sets).select("table_id", "key", F.lit("rat").alias("func"), "value", "inverse", "unit"),
        percentages(sets).select("table_id", "key", F.lit("percentage").alias("func"), "value", "inverse", "unit"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
