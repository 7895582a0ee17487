"""Queries over grids, pairs, priors, edges and corpora; registered into the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import quantity as Q
from cellweave.functions import similarity as S
from cellweave.functions import text as T
from cellweave.operators import evaluate, filtering, graph, pairs, stats, virtual
from cellweave.plans import inputs as I
from cellweave.plans.catalog import R6, STOP, TOKENS, add, r6
from cellweave.plans.inputs import table, with_

# Virtual cells. The last column of each table counts as headed by an aggregate.


def cells(s, d) -> DataFrame:
    return I.grid(s, d).withColumn("aggregate", F.col("c") == F.max("c").over(Window.partitionBy("table_id")))


VEC = with_("grid") + """,
it AS (SELECT table_id, 'row' AS axis, r AS line, c AS pos, cell_id, v, unit, c = max(c) OVER (PARTITION BY table_id) AS agg FROM grid
  UNION ALL SELECT table_id, 'col', c, r, cell_id, v, unit, c = max(c) OVER (PARTITION BY table_id) FROM grid),
vec AS (SELECT table_id, axis, line, list({'id': cell_id, 'v': v, 'u': unit, 'agg': agg} ORDER BY pos) AS items FROM it GROUP BY ALL HAVING count(*) > 1),
pr AS (SELECT a.table_id, a.axis, a.line, a.cell_id AS ai, a.v AS av, a.unit AS au, b.cell_id AS bi, b.v AS bv FROM it a JOIN it b
  ON a.table_id = b.table_id AND a.axis = b.axis AND a.line = b.line AND a.pos < b.pos AND a.unit IS NOT DISTINCT FROM b.unit),
every AS (SELECT table_id, axis, line, 0 AS kind, list_transform(items, lambda x: x.id) AS ids, list_transform(items, lambda x: x.v) AS vs, list_transform(items, lambda x: x.u) AS us FROM vec
  UNION ALL SELECT table_id, axis, line, 1, list_transform(items[1:len(items) - 1], lambda x: x.id), list_transform(items[1:len(items) - 1], lambda x: x.v),
    list_transform(items[1:len(items) - 1], lambda x: x.u) FROM vec WHERE len(items) > 4 AND items[len(items)].agg
  UNION ALL SELECT table_id, axis, line, 2, [ai, bi], [av, bv], [au, au] FROM pr),
sets AS (SELECT *, array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), ',') AS key FROM every
  QUALIFY row_number() OVER (PARTITION BY table_id, array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), ',') ORDER BY axis DESC, line, kind) = 1),
sums AS (SELECT table_id, key, us[1] AS unit, len(vs) AS n, (SELECT sum(CAST(round(x.v * 100) AS BIGINT)) FROM (SELECT unnest(vs) AS v, unnest(us) AS u) x WHERE x.u IS NOT DISTINCT FROM us[1]) AS cents FROM sets)
"""
R2 = "floor(({}) * 100 + 0.5) / 100"
rounded_sum = lambda df, c: df.withColumn(c, F.round(F.col(c) * 100).cast("long") / 100)
add("prj_20_vectors", lambda s, d: virtual.vectors(cells(s, d)).select("table_id", "axis", "line", F.array_join(F.transform("items", lambda x: x["cell_id"].cast("string")), ",").alias("ids")), VEC + "SELECT table_id, axis, line, array_to_string(list_transform(items, lambda x: CAST(x.id AS VARCHAR)), ',') AS ids FROM vec")
add("flt_10_unit_pairs", lambda s, d: virtual.pairs(cells(s, d)).select("table_id", "axis", "line", F.col("a.cell_id").alias("a"), F.col("b.cell_id").alias("b")), VEC + "SELECT table_id, axis, line, ai AS a, bi AS b FROM pr")
add("vag_01_subsets", lambda s, d: virtual.subsets(cells(s, d)).select("table_id", "key", "kind"), VEC + "SELECT table_id, key, kind FROM sets")
add(
    "vag_02_sum_and_average",
    lambda s, d: virtual.sum_and_average(virtual.subsets(cells(s, d))).select("table_id", "key", (F.round(F.col("sum") * 100).cast("long") / 100.0).alias("sum"), r6(F.round(F.col("sum") * 100).cast("long") / 100.0 / (F.size(F.split("key", ",")))).alias("avg")),
    VEC + f"SELECT table_id, key, cents / 100.0::DOUBLE AS sum, {R6.format('cents / 100.0::DOUBLE / n')} AS avg FROM sums WHERE cents <> 0",
)
TWO = "FROM (SELECT table_id, key, vs[1] AS a, vs[2] AS b, us[1] AS u FROM sets WHERE len(vs) = 2) WHERE a <> 0 AND b <> 0"
add("vag_03_difference", lambda s, d: virtual.differences(virtual.subsets(cells(s, d))), VEC + f"SELECT table_id, key, abs(a - b) AS value, b - a AS inverse {TWO}")
add("vag_04_change_ratio", lambda s, d: virtual.change_ratios(virtual.subsets(cells(s, d))), VEC + f"SELECT table_id, key, abs({R2.format('100 * abs(a - b) / b')}) AS value, abs({R2.format('100 * abs(b - a) / a')}) AS inverse, '%' AS unit {TWO} AND u IS DISTINCT FROM '%'")
add("vag_05_percentage", lambda s, d: virtual.percentages(virtual.subsets(cells(s, d))), VEC + f"SELECT table_id, key, abs({R2.format('100 * a / b')}) AS value, {R2.format('100 * b / a')} AS inverse, '%' AS unit {TWO} AND u IS DISTINCT FROM '%'")
add("ctx_12_virtual_counts", lambda s, d: virtual.virtual_cells(cells(s, d)).groupBy("table_id", "func").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys")), None)
add(
    "win_10_adjacent_duplicates",
    lambda s, d: table(s, d, "lineitem").withColumn("again", F.lag("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).eqNullSafe(F.col("l_suppkey"))).where("not again").select("l_orderkey", "l_linenumber"),
    "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) IS DISTINCT FROM l_suppkey",
)

# Alignment of perturbed figures to their best cells: the smallest whole pipeline.


def reported(s, d) -> DataFrame:
    """One figure a row of each table: the row's largest cell, truncated."""
    top = Window.partitionBy("table_id", "r").orderBy(F.desc("cents"), "cell_id")
    g = I.grid(s, d).withColumn("n", F.row_number().over(top)).where("n = 1")
    return g.select("table_id", F.col("r").alias("mx"), F.col("cell_id").alias("gold"), (F.floor(F.col("cents") / 100000) * 1000.0).alias("x"))


def align(s, d) -> DataFrame:
    v = virtual.virtual_cells(cells(s, d)).where("func in ('dif', 'rat', 'percentage')")
    single = I.grid(s, d).select("table_id", F.col("cell_id").cast("string").alias("key"), F.lit("same").alias("func"), F.col("v").alias("t"), F.lit(None).cast("double").alias("inverse"), "unit")
    every = single.unionByName(v.select("table_id", "key", "func", F.col("value").alias("t"), "inverse", "unit"))
    p = pairs.candidate_pairs(reported(s, d).withColumn("x0", F.col("x")), every.withColumn("t0", F.col("t")), "table_id")
    p = pairs.value_features(p)
    best = Window.partitionBy("table_id", "mx").orderBy(F.desc("approx_sim"), "func", "key")
    return p.withColumn("n", F.row_number().over(best)).where("n = 1").select("table_id", "mx", "gold", "key", "func", "approx_sim")


ALIGN = VEC + f""", rep AS (SELECT table_id, r AS mx, cell_id AS gold, floor(cents / 100000.0::DOUBLE) * 1000.0::DOUBLE AS x FROM grid
  QUALIFY row_number() OVER (PARTITION BY table_id, r ORDER BY cents DESC, cell_id) = 1),
every2 AS (SELECT table_id, CAST(cell_id AS VARCHAR) AS key, 'same' AS func, v AS t, NULL::DOUBLE AS inv, unit FROM grid
  UNION ALL SELECT table_id, key, 'dif', abs(a - b), b - a, u {TWO}
  UNION ALL SELECT table_id, key, 'rat', abs({R2.format('100 * abs(a - b) / b')}), abs({R2.format('100 * abs(b - a) / a')}), '%' {TWO} AND u IS DISTINCT FROM '%'
  UNION ALL SELECT table_id, key, 'percentage', abs({R2.format('100 * a / b')}), {R2.format('100 * b / a')}, '%' {TWO} AND u IS DISTINCT FROM '%'),
p0 AS (SELECT table_id, mx, gold, key, func, inv, t, x AS x0, CASE WHEN x < 1 AND unit = '%' THEN x * 100 ELSE x END AS x FROM rep JOIN every2 USING (table_id)),
p1 AS (SELECT * REPLACE (CASE WHEN inv <> 0 AND abs(x - inv) < abs(x - t) THEN inv ELSE t END AS t) FROM p0),
p2 AS (SELECT *, CASE WHEN greatest(x, t) = 0 THEN abs(x - t) ELSE abs(x - t) / abs(greatest(x, t)) END AS rm, CASE WHEN x + t = 0 THEN abs(x - t) ELSE abs(x - t) / abs(x + t) END AS rs,
  CASE WHEN greatest(x0, t) = 0 THEN abs(x0 - t) ELSE abs(x0 - t) / abs(greatest(x0, t)) END AS r0 FROM p1)
"""
add("align_revenue_best_cell", align, ALIGN + "SELECT table_id, mx, gold, key, func, greatest(1 - rm, 1 - r0) AS approx_sim FROM p2 QUALIFY row_number() OVER (PARTITION BY table_id, mx ORDER BY greatest(1 - rm, 1 - r0) DESC, func, key) = 1")


def value_pairs(s, d) -> DataFrame:
    single = I.grid(s, d).select("table_id", "cell_id", F.col("v").alias("t"), F.col("v").alias("t0"), F.lit(None).cast("double").alias("inverse"), "unit")
    return pairs.value_features(pairs.candidate_pairs(reported(s, d).withColumn("x0", F.col("x")), single, "table_id"))


VP = with_("grid") + """, rep AS (SELECT table_id, r AS mx, cell_id AS gold, floor(cents / 100000.0::DOUBLE) * 1000.0::DOUBLE AS x FROM grid
  QUALIFY row_number() OVER (PARTITION BY table_id, r ORDER BY cents DESC, cell_id) = 1),
vp AS (SELECT table_id, mx, gold, cell_id, x, v AS t, abs(x - v) / abs(greatest(x, v)) AS rm, abs(x - v) / abs(x + v) AS rs FROM rep JOIN grid USING (table_id))
"""
add("num_04_relative_differences", lambda s, d: value_pairs(s, d).select("table_id", "mx", "cell_id", "rel_max", "rel_sum", "rel_noscale"), VP + "SELECT table_id, mx, cell_id, rm AS rel_max, rs AS rel_sum, rm AS rel_noscale FROM vp")
add("num_05_approximate_similarity", lambda s, d: value_pairs(s, d).select("table_id", "mx", "cell_id", "approx_sim"), VP + "SELECT table_id, mx, cell_id, 1 - rm AS approx_sim FROM vp")
add("jon_04_mention_cell_pairs", lambda s, d: pairs.candidate_pairs(reported(s, d), I.grid(s, d), "table_id").groupBy("table_id").agg(F.count("*").alias("n")), VP + "SELECT table_id, count(*) AS n FROM vp GROUP BY table_id")
add("flt_09_potential_pairs", lambda s, d: value_pairs(s, d).where(pairs.potential(F.col("rel_max"), F.lit(0.0), F.lit(0.0))).select("table_id", "mx", "cell_id"), VP + "SELECT table_id, mx, cell_id FROM vp WHERE rm <= 0.5")
add("agg_20_normalised_feature", lambda s, d: pairs.normalised(value_pairs(s, d).withColumn("f", 1 - F.col("rel_max")), "f", ["table_id", "mx"]).select("table_id", "mx", "cell_id", "f"), VP + "SELECT table_id, mx, cell_id, (1 - rm) / max(1 - rm) OVER (PARTITION BY table_id, mx) AS f FROM vp")
add(
    "win_01_top_k_negatives",
    lambda s, d: pairs.top_k(value_pairs(s, d).select("table_id", "mx", "cell_id", F.col("approx_sim").alias("sim"), F.col("cell_id").alias("arrival"), (F.col("cell_id") == F.col("gold")).cast("int").alias("gt")), 3, ["table_id", "mx"]).select("table_id", "mx", "cell_id", "gt"),
    VP + "SELECT table_id, mx, cell_id, CAST(cell_id = gold AS INT) AS gt FROM vp QUALIFY row_number() OVER (PARTITION BY table_id, mx ORDER BY cell_id = gold DESC, 1 - rm DESC, cell_id DESC) <= greatest(4, sum(CAST(cell_id = gold AS INT)) OVER (PARTITION BY table_id, mx))",
)
add(
    "win_02_arg_max",
    lambda s, d: I.priors(s, d).groupBy("mx").agg(F.min(F.struct((-F.col("prob")).alias("p"), "mt")).alias("b")).where("b.p <= -0.5").select("mx", F.col("b.mt").alias("mt"), (-F.col("b.p")).alias("prob")),
    with_("priors") + "SELECT mx, mt, prob FROM priors QUALIFY row_number() OVER (PARTITION BY mx ORDER BY prob DESC, mt) = 1 AND prob >= 0.5",
)
ORDER3 = with_("priors") + "SELECT mx, CAST(count(*) FILTER (WHERE prob >= 0.5) AS BIGINT) AS strong, max(prob) AS best"
add("win_03_mention_order", lambda s, d: filtering.mention_order(I.priors(s, d).withColumn("doc", F.col("mx") % 100), 0.5).select("mx", "strong", "best", "place"), ORDER3 + ", CAST(row_number() OVER (PARTITION BY mx % 100 ORDER BY count(*) FILTER (WHERE prob >= 0.5), max(prob) DESC, mx) AS INT) AS place FROM priors GROUP BY mx")
ENT = with_("priors") + f", t AS (SELECT *, prob / sum(prob) OVER (PARTITION BY mx) AS p FROM priors), e AS (SELECT mx, {R6.format('-sum(p * ln(p))')} AS entropy FROM t GROUP BY mx)\n"
add("win_04_entropy_order", lambda s, d: I.priors(s, d).groupBy("mx").agg(F.array_sort(F.collect_list("prob")).alias("p")).select("mx", r6(Q.entropy("p")).alias("entropy")).withColumn("place", F.row_number().over(Window.partitionBy(F.col("mx") % 50).orderBy("entropy", "mx"))), ENT + "SELECT mx, entropy, CAST(row_number() OVER (PARTITION BY mx % 50 ORDER BY entropy, mx) AS INT) AS place FROM e")
add("win_05_top_priors", lambda s, d: filtering.top_priors(I.priors(s, d), 3).select("mx", "mt", "rank"), with_("priors") + "SELECT mx, mt, CAST(row_number() OVER (PARTITION BY mx ORDER BY prob DESC, mt) AS INT) AS rank FROM priors QUALIFY row_number() OVER (PARTITION BY mx ORDER BY prob DESC, mt) <= 3")
texted = lambda s, d: I.priors(s, d).withColumns({"mx_text": (F.col("mx") % 100).cast("string"), "mt_text": (F.col("mt") % 10 + (F.col("mx") % 3) * 10).cast("string")})
MT = """, t AS (SELECT *, CAST(mx % 100 AS VARCHAR) AS a, CAST(mt % 10 + (mx % 3) * 10 AS VARCHAR) AS b FROM priors),
k AS (SELECT mx, CASE WHEN a = b THEN 'exact' WHEN starts_with(a, b) OR starts_with(b, a) THEN 'truncated' ELSE 'approximate' END AS kind FROM t QUALIFY row_number() OVER (PARTITION BY mx ORDER BY prob DESC, mt) <= 5),
n AS (SELECT mx, count(*) FILTER (WHERE kind = 'exact') AS e, count(*) FILTER (WHERE kind = 'approximate') AS a, count(*) FILTER (WHERE kind = 'truncated') AS t FROM k GROUP BY mx),
mt AS (SELECT mx, CASE WHEN e > a AND e > t THEN 'exact' WHEN a > e AND a > t THEN 'approximate' ELSE 'truncated' END AS mention_type FROM n)
"""
add("win_06_mention_type", lambda s, d: filtering.mention_type(texted(s, d)), with_("priors") + MT + "SELECT mx, mention_type FROM mt")
add("win_06_adaptive_k", lambda s, d: filtering.adaptive(texted(s, d)).select("mx", "mt", "k", "rank"), with_("priors") + MT + """, q AS (SELECT *, prob / sum(prob) OVER (PARTITION BY mx) AS p FROM priors), e AS (SELECT mx, -sum(p * ln(p)) AS h FROM q GROUP BY mx)
SELECT mx, mt, k, rank FROM (SELECT priors.mx, priors.mt, CAST(CASE WHEN mention_type = 'exact' THEN 5 WHEN h < 3 THEN 10 ELSE 15 END AS INT) AS k, CAST(row_number() OVER (PARTITION BY mx ORDER BY prob DESC, mt) AS INT) AS rank FROM priors JOIN mt USING (mx) JOIN e USING (mx)) WHERE rank <= k""")
add(
    "win_07_second_label",
    lambda s, d: table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("p1"), (F.col("p_size") % 5).alias("p2"), (F.col("p_partkey") % 3).alias("p3")).select("p_partkey", filtering.second_label({"same": "p1", "sum": "p2", "dif": "p3"}).alias("label")),
    "WITH p AS (SELECT p_partkey, unnest([p_partkey % 7, p_size % 5, p_partkey % 3]) AS p, unnest(['same', 'sum', 'dif']) AS label FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p DESC, label) AS n FROM p) SELECT a.p_partkey, CASE WHEN a.label = 'same' THEN b.label ELSE a.label END AS label FROM r a JOIN r b ON a.p_partkey = b.p_partkey AND a.n = 1 AND b.n = 2",
)
seq = lambda s, d: I.priors(s, d).where("gt = 1").select("mx", "func", F.col("mt").alias("seq"))
FIRST = with_("priors") + ", f AS (SELECT mx, func, mt AS seq FROM priors WHERE gt = 1 QUALIFY row_number() OVER (PARTITION BY mx ORDER BY CAST(func = 'same' AS INT), mt) = 1)\n"
add("win_09_first_gold", lambda s, d: pairs.first_gold(seq(s, d), ["mx"]), FIRST + "SELECT mx, func, seq FROM f")
add("flt_13_gold_exclusion", lambda s, d: pairs.excluded_gold(I.priors(s, d).select("mx", "mt", "func"), pairs.first_gold(seq(s, d), ["mx"]), ["mx"]).select("mx", "mt", "func"), FIRST + "SELECT mx, mt, func FROM priors WHERE NOT (func = 'same' AND mx IN (SELECT mx FROM f WHERE func <> 'same'))")
add("win_11_strong_candidates", lambda s, d: I.priors(s, d).groupBy("mx").agg(F.count_if(F.col("prob") >= 0.5).alias("n")).where("n > 1"), with_("priors") + "SELECT mx, count(*) FILTER (WHERE prob >= 0.5) AS n FROM priors GROUP BY mx HAVING count(*) FILTER (WHERE prob >= 0.5) > 1")
add("win_12_conflicts", lambda s, d: filtering.conflicts(I.priors(s, d)).select("mx", "mt", "prob", "gold_score"), with_("priors") + "SELECT mx, mt, prob, g AS gold_score FROM (SELECT *, max(CASE WHEN gt = 1 THEN prob END) OVER (PARTITION BY mx) AS g FROM priors) WHERE gt = 0 AND prob > g")
seconds = lambda s, d: I.priors(s, d).withColumn("second", F.expr("case mx % 3 when 0 then 'sum' when 1 then 'dif' else 'rat' end"))
PRUNE = with_("priors") + """, p AS (SELECT *, CASE mx % 3 WHEN 0 THEN 'sum' WHEN 1 THEN 'dif' ELSE 'rat' END AS second FROM priors),
kept AS (SELECT * FROM p WHERE sim >= 0.9 AND (func = 'same' OR CASE WHEN pred <> 'same' THEN func = pred ELSE func = second OR (func = 'dif' AND second = 'sum') OR (func = 'sum' AND second = 'dif') OR (func = 'percentage' AND second = 'rat') END))
"""
add("flt_12_pruned", lambda s, d: filtering.pruned(seconds(s, d)).select("mx", "mt", "func"), PRUNE + "SELECT mx, mt, func FROM kept")

# Evaluation.
outcomes = lambda s, d: evaluate.top1(I.priors(s, d))
OUT = with_("priors") + """, o AS (SELECT *, CASE WHEN n = 1 AND prob >= 0.5 THEN CASE WHEN gt = 1 THEN 'tp' ELSE 'fp' END WHEN gt = 1 THEN 'fn' ELSE 'tn' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY mx ORDER BY prob DESC, mt) AS n FROM priors)),
cf AS (SELECT CASE WHEN grouping(func) = 1 THEN 'all' ELSE func END AS func, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'tn') AS tn, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM o GROUP BY ROLLUP (func))
"""
add("agg_16_top1_baseline", lambda s, d: outcomes(s, d).groupBy("outcome").agg(F.count("*").alias("n")), OUT + "SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
add("agg_14_confusion", lambda s, d: evaluate.confusion(outcomes(s, d)), OUT + "SELECT * FROM cf")
METRICS = OUT + """, m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0) AS accuracy FROM cf)
SELECT *, (sensitivity + specificity) / 2 AS balanced, coalesce((2 * precision * sensitivity) / nullif(precision + sensitivity, 0), 0) AS f1 FROM m"""
add("agg_15_metrics", lambda s, d: evaluate.metrics(evaluate.confusion(outcomes(s, d))), METRICS)
add("mll_07_kappa", lambda s, d: evaluate.kappa(evaluate.confusion(outcomes(s, d))).select("func", r6(F.col("kappa")).alias("kappa")), OUT + f", k AS (SELECT *, (tp + fp + tn + fn)::DOUBLE AS n FROM cf), e AS (SELECT *, ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n * n) AS c FROM k) SELECT func, {R6.format('coalesce(((tp + tn) / n - c) / nullif(1 - c, 0), 0)')} AS kappa FROM e")
add("mll_08_auc", lambda s, d: evaluate.auc(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("label"))).select(r6(F.col("auc")).alias("auc")), f"WITH x AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT {R6.format('(SELECT sum(CASE WHEN a.s > b.s THEN 2 WHEN a.s = b.s THEN 1 ELSE 0 END) FROM x a, x b WHERE a.y = 1 AND b.y = 0)::DOUBLE / (2 * count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))')} AS auc FROM x")
add("agg_13_case_matrix", lambda s, d: evaluate.case_matrix(I.priors(s, d).withColumn("equal", F.col("mt") % 10 == 1)), with_("priors") + "SELECT func, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in {"pos": "gt = 1", "neg": "gt = 0", "eq_total": "mt % 10 = 1", "eq_pos": "mt % 10 = 1 AND gt = 1", "eq_neg": "mt % 10 = 1 AND gt = 0", "fn": "gt = 1 AND prob < 0.5", "fp": "gt = 0 AND prob > 0.5", "eq_fn": "mt % 10 = 1 AND gt = 1 AND prob < 0.5", "eq_fp": "mt % 10 = 1 AND gt = 0 AND prob > 0.5"}.items()) + " FROM priors GROUP BY func")
add("agg_17_pruning_recall", lambda s, d: evaluate.recall(I.priors(s, d).withColumn("kept", F.col("sim") >= 0.9)), with_("priors") + "SELECT func, count(*) FILTER (WHERE sim >= 0.9) AS n_kept, count(*) FILTER (WHERE sim < 0.9) AS n_dropped, count(*) FILTER (WHERE sim >= 0.9)::DOUBLE / count(*) AS recall FROM priors WHERE gt = 1 GROUP BY func")
add("agg_18_rank_recall", lambda s, d: evaluate.rank_recall(I.priors(s, d), ["prob", "sim"], 2), with_("priors") + ", l AS (SELECT mx, mt, gt, 'prob' AS feature, prob AS x FROM priors UNION ALL SELECT mx, mt, gt, 'sim', sim FROM priors) SELECT feature, count(*) FILTER (WHERE gt = 1 AND n > 2) AS missed FROM (SELECT *, row_number() OVER (PARTITION BY mx, feature ORDER BY x DESC, mt) AS n FROM l) GROUP BY feature")
add("agg_08_relation_counts", lambda s, d: I.priors(s, d).rollup("func").agg(F.count_if(F.col("gt") == 1).alias("pos"), F.count_if(F.col("gt") == 0).alias("neg")).fillna({"func": "all"}), with_("priors") + "SELECT coalesce(func, 'all') AS func, count(*) FILTER (WHERE gt = 1) AS pos, count(*) FILTER (WHERE gt = 0) AS neg FROM priors GROUP BY ROLLUP (func)")
add("agg_09_quantiles", lambda s, d: I.priors(s, d).groupBy("func").agg(F.expr("percentile(prob, array(0, 0.25, 0.5, 0.75, 1))").alias("q")).select("func", *[r6(F.col("q")[i]).alias(f"q{i}") for i in range(5)]), with_("priors") + "SELECT func, " + ", ".join(f"{R6.format(f'quantile_cont(prob, {p})')} AS q{i}" for i, p in enumerate((0, 0.25, 0.5, 0.75, 1))) + " FROM priors GROUP BY func")
add("agg_10_distinct_counts", lambda s, d: I.priors(s, d).agg(F.countDistinct("mx").alias("mentions"), F.countDistinct(F.when(F.col("gt") == 1, F.col("mx"))).alias("positive")), with_("priors") + "SELECT count(DISTINCT mx) AS mentions, count(DISTINCT CASE WHEN gt = 1 THEN mx END) AS positive FROM priors")
add("agg_11_split_sizes", lambda s, d: I.priors(s, d).groupBy((F.col("mx") % 10 == 7).alias("held_out")).agg(F.count("*").alias("n"), F.count_if(F.col("gt") == 1).alias("pos")), with_("priors") + "SELECT mx % 10 = 7 AS held_out, count(*) AS n, count(*) FILTER (WHERE gt = 1) AS pos FROM priors GROUP BY 1")
add("agg_12_class_weights", lambda s, d: I.priors(s, d).groupBy("gt").agg(F.count("*").alias("n")).withColumn("weight", 0.5 / F.col("n")), with_("priors") + "SELECT gt, count(*) AS n, 0.5::DOUBLE / count(*) AS weight FROM priors GROUP BY gt")
add("flt_15_case_slices", lambda s, d: I.priors(s, d).where("gt = 1 and prob < 0.5 and contains(func, 'perc')").select("mx", "mt"), with_("priors") + "SELECT mx, mt FROM priors WHERE gt = 1 AND prob < 0.5 AND contains(func, 'perc')")
add("mll_04_grouped_folds", lambda s, d: I.priors(s, d).groupBy((F.col("mx") % 10).alias("fold")).agg(F.countDistinct("mx").alias("docs"), F.count("*").alias("n")), with_("priors") + "SELECT mx % 10 AS fold, count(DISTINCT mx) AS docs, count(*) AS n FROM priors GROUP BY 1")
add("prj_23_dummies", lambda s, d: pairs.dummies(I.priors(s, d).select("mx", "mt", F.expr("case mt % 4 when 0 then 'approx' when 1 then 'bound' when 2 then 'exact' end").alias("modifier"))), with_("priors") + "SELECT mx, mt, m AS modifier, CAST(m IS NOT DISTINCT FROM 'approx' AS INT) AS modapprox, CAST(m IS NOT DISTINCT FROM 'bound' AS INT) AS modbound, CAST(m IS NOT DISTINCT FROM 'exact' AS INT) AS modexact, CAST(m IS NULL AS INT) AS \"modNone\" FROM (SELECT mx, mt, CASE mt % 4 WHEN 0 THEN 'approx' WHEN 1 THEN 'bound' WHEN 2 THEN 'exact' END AS m FROM priors)")

# Graphs.
ment = lambda s, d: table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 500).alias("start"), F.col("l_quantity").alias("value"), (F.col("l_quantity") * 2).alias("raw"))
add(
    "prj_16_text_edges",
    lambda s, d: graph.text_edges(ment(s, d)),
    "WITH m AS (SELECT l_orderkey AS doc, l_linenumber AS seq, l_partkey % 500 AS start, l_quantity AS value FROM lineitem) SELECT a.doc, a.seq AS src, b.seq AS dst, 5.0::DOUBLE / abs(a.start - b.start) AS proximity, (abs(a.value - b.value) / greatest(a.value, b.value) + abs(a.value * 2 - b.value * 2) / greatest(a.value * 2, b.value * 2)) / 2 AS value_diff FROM m a JOIN m b ON a.doc = b.doc AND a.seq < b.seq WHERE a.start <> b.start",
)
add(
    "prj_17_cell_edges",
    lambda s, d: graph.cell_edges(I.grid(s, d)).select("table_id", "src", "dst", F.col("distance").cast("int").alias("distance"), "value_diff"),
    with_("grid") + "SELECT a.table_id, a.cell_id AS src, b.cell_id AS dst, CASE WHEN a.r = b.r THEN abs(a.c - b.c) ELSE abs(a.r - b.r) END AS distance, abs(a.v - b.v) / greatest(a.v, b.v) AS value_diff FROM grid a JOIN grid b ON a.table_id = b.table_id AND a.cell_id < b.cell_id AND (a.r = b.r OR a.c = b.c)",
)
add("prj_17_source_edges", lambda s, d: graph.source_edges(virtual.differences(virtual.subsets(cells(s, d))).withColumn("func", F.lit("dif"))).select("table_id", "src", "dst"), VEC + f"SELECT table_id, key || '.dif' AS src, CAST(unnest(string_split(key, ',')) AS INT) AS dst FROM (SELECT table_id, key {TWO})")
add("prj_19_cell_distance", lambda s, d: I.grid(s, d).select("table_id", "cell_id", graph.cell_distance(F.col("r"), F.col("c"), F.lit(2), F.lit(3)).cast("int").alias("x")), with_("grid") + "SELECT table_id, cell_id, CASE WHEN r = 2 THEN abs(c - 3) WHEN c = 3 THEN abs(r - 2) ELSE 0 END AS x FROM grid")
prior_edges = lambda s, d: I.edges(s, d).select("doc", "src", "dst", (F.col("value_diff") / 2 + 0.25).alias("prob"))
GR = with_("edges") + """, pe AS (SELECT doc, src, dst, value_diff / 2 + 0.25::DOUBLE AS prob FROM edges),
g AS (SELECT doc, src, dst, prob AS w FROM pe UNION ALL SELECT doc, dst, src, 0.9::DOUBLE * proximity + (1 - 0.9::DOUBLE) * surface_sim FROM edges),
st AS (SELECT doc, src, dst, w / CAST(sum(CAST(w AS DECIMAL(26,12))) OVER (PARTITION BY doc, src) AS DOUBLE) AS w FROM g)
"""
the_graph = lambda s, d: graph.graph(I.edges(s, d), prior_edges(s, d))
add("grf_01_graph_online", lambda s, d: the_graph(s, d), GR + "SELECT * FROM g")
add("grf_02_graph_offline", lambda s, d: graph.graph(I.edges(s, d), prior_edges(s, d), both_ways=True), GR + "SELECT doc, src, dst, prob AS w FROM pe UNION ALL SELECT doc, dst, src, prob FROM pe")
add("grf_03_ablation_weight", lambda s, d: I.edges(s, d).select("doc", "src", "dst", r6(graph.ablation_weight(F.col("surface_sim"), F.col("value_diff"), F.col("proximity"))).alias("full"), r6(graph.ablation_weight(F.col("surface_sim"), F.col("value_diff"), F.col("proximity"), "surface")).alias("no_surface")), with_("edges") + f"SELECT doc, src, dst, {R6.format('CASE WHEN surface_sim * 0.4::DOUBLE + value_diff * 0.3::DOUBLE + proximity * 0.3::DOUBLE < 0.7::DOUBLE THEN 0 ELSE surface_sim * 0.4::DOUBLE + value_diff * 0.3::DOUBLE + proximity * 0.3::DOUBLE END')} AS full, {R6.format('CASE WHEN value_diff * 0.5::DOUBLE + proximity * 0.5::DOUBLE < 0.7::DOUBLE THEN 0 ELSE value_diff * 0.5::DOUBLE + proximity * 0.5::DOUBLE END')} AS no_surface FROM edges")
add("grf_04_stochastic", lambda s, d: graph.stochastic(the_graph(s, d)).select("doc", "src", "dst", r6(F.col("w")).alias("w")), GR + f"SELECT doc, src, dst, {R6.format('w')} AS w FROM st")
seeds = lambda s, d: I.edges(s, d).select("doc", F.col("src").alias("seed")).distinct()
add("grf_05_personalisation", lambda s, d: I.edges(s, d).select("doc", "src").distinct().withColumn("mass", F.when(F.col("src") == "m1", 1.0).otherwise(0.0)), with_("edges") + "SELECT DISTINCT doc, src, CASE WHEN src = 'm1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mass FROM edges")
WALK = GR + ", s0 AS (SELECT DISTINCT doc, src AS seed FROM edges), h0 AS (SELECT doc, seed, seed AS node, 1.0::DOUBLE AS mass FROM s0)"
for _i in range(4):
    WALK += f""", v{_i + 1} AS (SELECT h.doc, seed, dst AS node, 0.85::DOUBLE * CAST(sum(CAST(mass * w AS DECIMAL(26,12))) AS DOUBLE) AS mass FROM h{_i} h JOIN st ON h.doc = st.doc AND node = src GROUP BY ALL),
 h{_i + 1} AS (SELECT doc, seed, node, CAST(sum(CAST(mass AS DECIMAL(26,12))) AS DOUBLE) AS mass FROM (SELECT * FROM v{_i + 1} UNION ALL SELECT s0.doc, s0.seed, s0.seed, 1 - coalesce(k, 0) FROM s0 LEFT JOIN (SELECT doc, seed, CAST(sum(CAST(mass AS DECIMAL(26,12))) AS DOUBLE) AS k FROM v{_i + 1} GROUP BY ALL) USING (doc, seed)) GROUP BY ALL)"""
add("grf_06_random_walk", lambda s, d: graph.walk(graph.stochastic(the_graph(s, d)), seeds(s, d), 4).select("doc", "seed", "node", r6(F.col("mass")).alias("mass")), WALK + f" SELECT doc, seed, node, {R6.format('mass')} AS mass FROM h4")
add("grf_07_without_candidates", lambda s, d: graph.without_candidates(the_graph(s, d), seeds(s, d).where("seed = 'm1'")), GR + "SELECT * FROM g WHERE NOT (src = 'm1' AND contains(dst, '.'))")
add("grf_08_rescale", lambda s, d: graph.rescaled(prior_edges(s, d), ["doc", "src"], "prob").select("doc", "src", "dst", r6(F.col("prob")).alias("prob")), GR + f"SELECT doc, src, dst, {R6.format('prob / CAST(sum(CAST(prob AS DECIMAL(26,12))) OVER (PARTITION BY doc, src) AS DOUBLE)')} AS prob FROM pe")
add("grf_09_joint_resolution", lambda s, d: graph.resolve(the_graph(s, d), prior_edges(s, d)))
add("grf_10_resolution_outcomes", lambda s, d: evaluate.confusion(graph.resolve(the_graph(s, d), prior_edges(s, d)).withColumns({"func": F.lit("same"), "outcome": evaluate.outcome(F.col("cell").isNotNull(), (F.col("cell") == "t.1").cast("int"))})))
add("grf_11_parameter_grid", lambda s, d: graph.parameter_grid(s), "SELECT a / 10.0::DOUBLE AS alpha, t / 10.0::DOUBLE AS threshold, l / 10.0::DOUBLE AS lambda1, (10 - a) / 10.0::DOUBLE AS beta, (10 - l) / 10.0::DOUBLE AS lambda2 FROM range(11) x(a), range(6) y(t), range(11) z(l)")
add("agg_22_graph_sizes", lambda s, d: the_graph(s, d).groupBy("doc").agg(F.count("*").alias("e"), F.countDistinct("src").alias("n")).agg(r6(F.avg("e")).alias("edges"), r6(F.avg("n")).alias("nodes")), GR + f"SELECT {R6.format('avg(e)')} AS edges, {R6.format('avg(n)')} AS nodes FROM (SELECT doc, count(*) AS e, count(DISTINCT src) AS n FROM g GROUP BY doc)")
