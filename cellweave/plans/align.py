"""The pipelines: pages to alignments, and pages to an annotation set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave import sources
from cellweave.functions import quantity as Q
from cellweave.functions import similarity as S
from cellweave.functions import text as T
from cellweave.operators import graph, html, pairs, recognise, virtual

#: Candidates of a mention that go on to joint resolution.
TOP_K = 7
#: A pair further apart in value than this is no candidate.
LEAST_SIM = 0.3


def documents(parsed: DataFrame) -> DataFrame:
    """doc (page_id:block_no), page_id, block_no, text: admitted blocks of pages that have tables."""
    b = parsed.where(F.size("tables") > 0).select("page_id", F.posexplode(T.blocks(F.col("content"))).alias("block_no", "text"))
    return b.where(T.block_admitted(F.col("text"))).select(F.concat_ws(":", "page_id", "block_no").alias("doc"), "page_id", "block_no", "text")


def text_mentions(docs: DataFrame) -> DataFrame:
    """Quantities of each document with value, scale, unit and modifier from their surroundings."""
    m = recognise.extract(docs, "doc", "page_id").join(docs.select("doc", "text"), "doc")
    low = F.lower("surface")
    before, after = T.tokens(F.substr("text", F.lit(1), F.col("start"))), T.tokens(F.substr("text", F.col("stop") + 2))
    m = m.withColumns({"before": F.filter(before, lambda t: t != ""), "after": F.filter(after, lambda t: t != "")})
    near = Q.neighbour_scale_unit("before", "after")
    own = F.when(Q.scale_of(low) != 1, Q.scale_of(low))
    m = sources.kept(m.withColumns({"x0": Q.value(low), "near": near, "own": own}))
    return m.where("x0 is not null").select(
        "doc", "page_id", F.concat(F.lit("x"), F.col("mention_id").cast("string")).alias("mx"), "start", "surface", "x0",
        Q.scaled_value("x0", F.coalesce("own", "near.scale"), F.coalesce(Q.unit_of(low), "near.unit"), F.lit(1.0)).alias("x"),
        F.coalesce(Q.unit_of(low), "near.unit").alias("x_unit"), Q.modifier(Q.frame("before", "after")).alias("modifier"),
        Q.aggregate_named(Q.frame("before", "after")).alias("x_func"),
    )


def cells_of(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Real and virtual cells of admitted tables (page_id, table_id, mt, func, t, t0, inverse, unit, cell_text), and their edges (page_id, src, dst, proximity)."""
    slots = parsed.select("page_id", F.explode("tables").alias("t")).select("page_id", "t.table_id", F.explode("t.cells").alias("x")).select("page_id", "table_id", "x.*")
    slots = sources.kept(slots)
    slots = slots.join(html.table_sizes(slots).where("admitted").select("page_id", "table_id"), ["page_id", "table_id"])
    real = sources.kept(html.with_context(html.cell_mentions(slots), slots))
    none = F.lit(None).cast("double")
    single = real.select("page_id", "table_id", F.concat_ws(".", F.lit("t"), "table_id", "cell_id").alias("mt"), F.lit("same").alias("func"), Q.scaled_value("v", "scale", "unit", F.lit(1.0)).alias("t"), F.col("v").alias("t0"), none.alias("inverse"), "unit", F.col("text").alias("cell_text"))
    flat = real.select(F.struct("page_id", "table_id").alias("table_id"), "r", "c", "cell_id", "v", "unit")
    virtuals = sources.kept(virtual.virtual_cells(flat))
    made = virtuals.select("table_id.page_id", "table_id.table_id", F.concat_ws(".", F.lit("t"), F.col("table_id.table_id"), "key", "func").alias("mt"), "func", F.col("value").alias("t"), F.col("value").alias("t0"), "inverse", "unit", F.col("value").cast("string").alias("cell_text"))
    node = lambda c: F.concat_ws(".", F.lit("t"), F.col("table_id.table_id"), F.col(c).cast("string"))
    named = lambda df: df.select("table_id.page_id", node("src").alias("src"), node("dst").alias("dst"), "proximity")
    edges = named(graph.cell_edges(flat)).unionByName(named(graph.source_edges(virtuals)))
    return single.unionByName(made), edges


def scored_pairs(mentions: DataFrame, cells: DataFrame) -> DataFrame:
    """The best pairs of each mention by value, with a prior from surface and value similarity."""
    p = pairs.value_features(pairs.candidate_pairs(mentions, cells, "page_id"))
    unit = F.when(F.col("x_unit").isNotNull() & F.col("unit").isNotNull(), S.unit_similarity("x_unit", "unit")).otherwise(0.0)
    p = p.where(F.col("approx_sim") >= LEAST_SIM).withColumn("unit_sim", unit).where("unit_sim >= 0")
    best = Window.partitionBy("doc", "mx").orderBy(F.desc("approx_sim"), F.desc("unit_sim"), (F.col("func") != "same").cast("int"), "mt")
    p = p.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_K)
    # The string similarity is the dear one; only the survivors have it.
    surface = S.jaro(F.lower("surface"), F.col("cell_text"))
    return p.withColumn("surface_sim", surface).withColumn("prob", 0.4 * F.col("surface_sim") + 0.3 * F.col("approx_sim") + 0.3 * F.greatest("unit_sim", F.lit(0.5)))


def align_pages(pages: DataFrame, **options) -> DataFrame:
    """doc, mention, cell, score: quantities of each page's text linked to real or computed cells of its tables."""
    parsed = sources.kept(html.parsed(pages))
    mentions = sources.kept(text_mentions(documents(parsed)))
    cells, near = cells_of(parsed)
    p = sources.kept(scored_pairs(mentions, cells))
    priors = p.select("doc", F.col("mx").alias("src"), F.col("mt").alias("dst"), "prob")
    m = mentions.select("doc", F.col("mx").alias("seq"), "start", F.col("x").alias("value"), F.col("x0").alias("raw"))
    # Of the tables' edges, those between candidates of a document.
    mine = p.select("doc", "page_id", "mt").distinct()
    between = near.join(mine.withColumnRenamed("mt", "src"), ["page_id", "src"]).join(mine.select("doc", F.col("mt").alias("dst")), ["doc", "dst"])
    edges = graph.text_edges(m).select("doc", "src", "dst", "proximity").unionByName(between.select("doc", "src", "dst", "proximity"))
    edges = sources.kept(edges.withColumn("surface_sim", F.lit(0.0)))
    return graph.resolve(graph.graph(edges, priors), priors, **options)


def annotation_set(pages: DataFrame, journal: DataFrame) -> dict[str, DataFrame]:
    """Entities for annotators from pages not yet in the journal: documents, tables, mentions and their links."""
    parsed = sources.kept(html.parsed(sources.not_yet(pages, journal)))
    docs = documents(parsed).withColumnRenamed("block_no", "doc_no")
    found = sources.kept(recognise.extract(docs, "page_id", "doc_no"))
    several = found.groupBy("page_id", "doc_no").agg(F.count("*").alias("n")).where("n >= 2")
    docs = docs.join(several.drop("n"), ["page_id", "doc_no"])
    tables = parsed.select("page_id", F.explode("tables").alias("t")).select(
        "page_id", F.col("t.table_id").alias("table_no"), "t.caption",
        T.word_set(F.concat_ws(" ", F.col("t.caption"), F.col("t.cells.text"))).alias("table_words"),
    )
    mentions = found.join(docs.select("page_id", "doc_no", T.word_set("text").alias("words")), ["page_id", "doc_no"])
    links = mentions.join(tables, "page_id").where(F.size(F.array_intersect("words", "table_words")) > 1).select("page_id", "doc_no", "mention_id", "table_no")
    return sources.entities(docs.select("page_id", "doc_no", "text"), tables.drop("table_words"), mentions.drop("words"), links)
