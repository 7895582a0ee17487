"""Rows of features, renderings, readers of results and the whole pipelines; registered into the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave import sources as R
from cellweave.functions import quantity as Q
from cellweave.functions import similarity as S
from cellweave.functions import text as T
from cellweave.operators import evaluate, graph, html, model, recognise
from cellweave.plans import align
from cellweave.plans import inputs as I
from cellweave.plans.catalog import SCALE, TOKENS, UNIT, VALUE, add
from cellweave.plans.catalog_sources import back, features, grid_of, report, table_pages
from cellweave.plans.catalog_tables import OUT, VP, outcomes, value_pairs
from cellweave.plans.inputs import table, with_

add("srt_04_limit_offset", lambda s, d: table(s, d, "part").select("p_partkey").orderBy(F.desc("p_partkey")).offset(10).limit(20), "SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 20 OFFSET 10")
add("prj_21_pair_feature_row", lambda s, d: value_pairs(s, d).select(F.concat_ws("\t", "table_id", "mx", "cell_id", F.col("approx_sim").cast("decimal(18,4)").cast("string")).alias("line")).groupBy(F.element_at(F.split("line", "\t"), 1).alias("t")).agg(F.count("*").alias("n")), VP + "SELECT CAST(table_id AS VARCHAR) AS t, count(*) AS n FROM vp GROUP BY 1")
add(
    "prj_22_mention_feature_row",
    lambda s, d: I.surfaces(s, d).select("id", Q.precision("surface").alias("prec"), Q.scale_of("surface").alias("scale"), F.coalesce(Q.unit_of("surface"), F.lit("None")).alias("unit")).join(I.priors(s, d).groupBy(F.col("mx").alias("id")).agg(F.max("gt").alias("gold")), "id", "left").select("id", "prec", "scale", "unit", F.coalesce("gold", F.lit(0)).alias("gold")).groupBy("gold", "unit").agg(F.count("*").alias("n")),
    with_("surfaces", "priors") + f"""SELECT gold, unit, count(*) AS n FROM (
      SELECT s.id, coalesce(g.gold, 0) AS gold, coalesce({UNIT}, 'None') AS unit
      FROM surfaces s LEFT JOIN (SELECT mx AS id, max(gt) AS gold FROM priors GROUP BY mx) g ON s.id = g.id) GROUP BY gold, unit""",
)
add("set_05_token_union", lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_union(T.tokens("text"), F.array(F.lit("extra"), F.lit("the")))), "|").alias("x")), f"SELECT item_id, array_to_string(list_sort(list_distinct(list_concat({TOKENS}, ['extra', 'the']))), '|') AS x FROM benchmark")
add("arr_01_slice_concat_sort", lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(F.concat(F.slice(T.tokens("text"), 1, 3), F.slice(T.tokens("text"), 2, 2))), "|").alias("x"), F.array_contains(T.tokens("text"), "the").alias("has")), f"SELECT item_id, array_to_string(list_sort(list_concat({TOKENS}[1:3], {TOKENS}[2:3])), '|') AS x, list_contains({TOKENS}, 'the') AS has FROM benchmark")
add("arr_02_flatten", lambda s, d: table(s, d, "benchmark").select("item_id", F.size(F.flatten(F.transform(T.tokens("text"), lambda t: F.split(t, "e")))).alias("n")), f"SELECT item_id, CAST(len(flatten(list_transform({TOKENS}, lambda t: string_split(t, 'e')))) AS INT) AS n FROM benchmark")
add("map_01_feature_struct", lambda s, d: I.surfaces(s, d).select("id", F.struct(Q.scale_of("surface").alias("scale"), Q.precision("surface").alias("prec")).alias("f")).select("id", "f.prec", F.col("f.scale").cast("long").alias("scale")).groupBy("prec", "scale").agg(F.count("*").alias("n")), with_("surfaces") + rf"SELECT length(regexp_extract({VALUE}, '\.(\d+)$', 1))::INT AS prec, CAST({SCALE} AS BIGINT) AS scale, count(*) AS n FROM surfaces GROUP BY 1, 2")
add("ctx_02_cell_unit", lambda s, d: html.with_context(html.cell_mentions(grid_of(s, d)), grid_of(s, d)).select("page_id", "cell_id", "unit"), with_("grid") + "SELECT table_id AS page_id, CAST((r - 1) * (SELECT max(c) FROM grid g WHERE g.table_id = grid.table_id) + c AS INT) AS cell_id, '$' AS unit FROM grid")
nested = lambda s, d: table_pages(s, d).select("page_id", F.concat(F.lit("<table><tr><td>outer"), "html", F.lit("</table>")).alias("html"))
add("flt_06_nested_tables", lambda s, d: html.parsed(nested(s, d)).select("page_id", F.size("tables").alias("n")), with_("grid") + "SELECT DISTINCT table_id AS page_id, 1 AS n FROM grid")
add("str_05_stemmed_phrases", lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(T.stem_all(T.phrases("text")), "|").alias("x")))
marked = lambda s, d: recognise.extract(report(s, d), "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("m")).join(report(s, d), "id")
add(
    "snk_13_marked_text",
    lambda s, d: marked(s, d).select(
        "id",
        F.expr("aggregate(reverse(m), text, (t, x) -> concat(substr(t, 1, x.start), '<b>', substr(t, x.start + 1, x.stop - x.start), '</b>', substr(t, x.stop + 1)))").alias("html"),
    ),
)
add("snk_08_ordered_print", lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.table_references(F.col("text"))).alias("n")).orderBy(F.desc("n"), "doc_id").select(F.concat_ws(" ", "doc_id", "n").alias("line")), r"SELECT concat_ws(' ', doc_id, len(regexp_extract_all(text, '[tT]able\.? ?\d+(?:\.\d+)*', 0))) AS line FROM documents")
add("snk_14_metrics_file", lambda s, d: back(s, lambda p: evaluate.confusion(outcomes(s, d)).write.option("header", True).csv(p), lambda p: s.read.option("header", True).csv(p).select("func", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"))), OUT + "SELECT func, tp, fp FROM cf")
add("grf_12_edge_files", lambda s, d: back(s, lambda p: R.write_tsv(I.edges(s, d).select("doc", "src", "dst"), p), lambda p: R.keyed_lines(s, p, 0).groupBy("key").agg(F.count("*").alias("n"))), with_("edges") + "SELECT CAST(doc AS VARCHAR) AS key, count(*) AS n FROM edges GROUP BY doc")


def reloaded(s, d):
    from pyspark.ml import PipelineModel

    path, df = R.scratch(s), features(s, d).withColumnRenamed("prob", "p0")
    model.train(df, ["p0", "sim", "same"], "logistic").save(path)
    return model.scored(PipelineModel.load(path), df).select("mx", "mt", "prob")


add("src_26_model_load", reloaded)
add("mll_03_margin_classifier", lambda s, d: model.train(features(s, d), ["prob", "sim", "same"], "svm").transform(features(s, d)).select("mx", "mt", "prediction"))
add("mll_11_split_counts", lambda s, d: I.priors(s, d).groupBy((F.col("mx") % 10 == 7).alias("held_out"), "gt").agg(F.count("*").alias("n"), F.countDistinct("mx").alias("mentions")), with_("priors") + "SELECT mx % 10 = 7 AS held_out, gt, count(*) AS n, count(DISTINCT mx) AS mentions FROM priors GROUP BY ALL")


def storied_pages(s, d):
    """Pages of a table and a paragraph that reports some of its figures."""
    said = I.grid(s, d).where("c = 1 and r <= 3").groupBy("table_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("In the region revenue came to $"), F.floor(F.col("cents") / 100).cast("string"), F.lit(" for one of its nations over the year"), ))), ". ").alias("story")
    )
    p = table_pages(s, d).join(said, F.col("page_id") == F.col("table_id"))
    return p.select("page_id", F.concat(F.lit("https://r.example/"), F.col("page_id").cast("string")).alias("url"), F.replace("html", F.lit("<p>Before.</p>"), F.concat(F.lit("<p>"), "story", F.lit(".</p>"))).alias("html"))


add("align_pages", lambda s, d: align.align_pages(storied_pages(s, d)))
add("ctx_15_annotation_set", lambda s, d: align.annotation_set(storied_pages(s, d), s.createDataFrame([], "url string"))["mention_table"])
legacy = lambda s, d: value_pairs(s, d).withColumn("x", F.lit("$"))
add("num_05_legacy_similarity", lambda s, d: legacy(s, d).select("table_id", "mx", "cell_id", (S.unit_similarity(F.lit("$"), F.lit("$"), 0.0) + 0.0 - F.col("rel_max")).alias("sim")), VP + "SELECT table_id, mx, cell_id, 1.0::DOUBLE - rm AS sim FROM vp")
add("prj_17_legacy_cell_edges", lambda s, d: graph.cell_edges(I.grid(s, d)).select("table_id", "src", "dst", (1.0 / F.col("distance")).alias("proximity")), with_("grid") + "SELECT a.table_id, a.cell_id AS src, b.cell_id AS dst, 1.0::DOUBLE / CASE WHEN a.r = b.r THEN abs(a.c - b.c) ELSE abs(a.r - b.r) END AS proximity FROM grid a JOIN grid b ON a.table_id = b.table_id AND a.cell_id < b.cell_id AND (a.r = b.r OR a.c = b.c)")
