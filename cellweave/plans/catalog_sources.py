"""Queries over sources, sinks, joins, statistics, pages and models; registered into the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave import sources as R
from cellweave.functions import quantity as Q
from cellweave.functions import similarity as S
from cellweave.functions import text as T
from cellweave.operators import html, model, pairs, recognise, stats
from cellweave.plans import inputs as I
from cellweave.plans.catalog import BLOCKS, STOP, SURF2, TOKENS, add, neighbours
from cellweave.plans.inputs import table, with_

# Sources: tables are written in the format at hand and read back by the reader under test.


def page_json(s, d) -> str:
    path = R.scratch(s)
    table(s, d, "pages").select(F.col("page_id").cast("string").alias("docID"), "url", F.col("html").alias("fullText")).write.json(path)
    return path


PAGES = 'SELECT CAST(page_id AS VARCHAR) AS "docID", url, length(html) AS n FROM pages'
page_rows = lambda df: df.select("docID", "url", F.length("fullText").cast("long").alias("n"))
add("src_01_json_lines", lambda s, d: page_rows(R.json_lines(s, page_json(s, d))), PAGES)


def array_files(s, d) -> str:
    """Files that each hold one JSON array."""
    path = R.scratch(s)
    one = F.to_json(F.struct(F.col("page_id").cast("string").alias("docID"), "url", F.col("html").alias("fullText")))
    rows = table(s, d, "pages").select(F.pmod(F.xxhash64("page_id"), F.lit(16)).alias("b"), one.alias("j")).groupBy("b")
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")).write.partitionBy("b").text(path)
    return path


add("src_02_json_whole", lambda s, d: page_rows(R.json_whole(s, f"{array_files(s, d)}/*")), PAGES)


def by_manifest(s, d) -> DataFrame:
    folder, listed = page_json(s, d), R.scratch(s)
    s.createDataFrame([(folder,)], "value string").coalesce(1).write.text(listed)
    return page_rows(R.json_lines(s, R.manifest(s, listed)))


add("src_03_manifest", by_manifest, PAGES)


def streamed(s, d) -> DataFrame:
    out, marks = R.scratch(s), R.scratch(s)
    rows = page_rows(R.json_stream(s, page_json(s, d)))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).parquet(out)


add("src_04_paged_stream", streamed, PAGES)
add("src_05_file_batches", lambda s, d: page_rows(R.json_lines(s, [page_json(s, d)])), PAGES)
add("src_06_documents_of_pages", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.blocks("text")).alias("b")).where(F.length("b") >= 100).groupBy("doc_id").agg(F.count("*").alias("n")), f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({BLOCKS}) AS b FROM documents) WHERE length(b) >= 100 GROUP BY doc_id")
orders, items, parts = (lambda n: lambda s, d: table(s, d, n))("orders"), (lambda n: lambda s, d: table(s, d, n))("lineitem"), (lambda n: lambda s, d: table(s, d, n))("part")


def documents_tables(s, d) -> DataFrame:
    wanted = items(s, d).where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    df = orders(s, d).join(items(s, d), F.col("o_orderkey") == F.col("l_orderkey")).join(parts(s, d), F.col("l_partkey") == F.col("p_partkey"))
    return df.join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "p_partkey", "p_brand").distinct().orderBy("o_orderkey", "p_partkey")


DT = "SELECT DISTINCT o_orderkey, p_partkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)"
add("src_07_documents_tables", documents_tables, DT)
add("jon_01_inner_joins", documents_tables, DT)
add("srt_01_order_by", lambda s, d: documents_tables(s, d).orderBy("p_brand", F.desc("o_orderkey"), "p_partkey"), DT + " ORDER BY p_brand, o_orderkey DESC, p_partkey")
add("src_08_mentions", lambda s, d: items(s, d).select("l_orderkey", "l_linenumber", "l_quantity").distinct().join(orders(s, d).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"), "SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
add("src_09_agreed_gold", lambda s, d: items(s, d).groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n")).where("n > 1"), "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
add("src_10_id_list", lambda s, d: orders(s, d).where(F.col("o_orderkey").isin(1, 7, 33, 100, 222)).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 7, 33, 100, 222)")
add("src_11_modulo_hold_out", lambda s, d: orders(s, d).where("o_custkey % 10 = 7").select("o_orderkey").join(items(s, d).groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n >= 2"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n"), "SELECT o_orderkey, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 2) ON o_orderkey = l_orderkey WHERE o_custkey % 10 = 7")
add("src_12_assembled_documents", lambda s, d: orders(s, d).select("o_orderkey").join(items(s, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey"))), ",").alias("parts")), "o_orderkey", "left"), "SELECT o_orderkey, parts FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS parts FROM (SELECT l_orderkey, concat_ws(':', l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem) GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
add("jon_03_nested_lookup", lambda s, d: orders(s, d).join(items(s, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")), "o_orderkey").select("o_orderkey", "n"), "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
add("src_13_limit_offset", lambda s, d: orders(s, d).select("o_orderkey").orderBy("o_orderkey").offset(200).limit(100), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")


def lines_tsv(s, d, sub: str = "") -> str:
    path = R.scratch(s)
    R.write_tsv(items(s, d).select(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag"), path + sub)
    return path


TSV = "SELECT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_linenumber AS VARCHAR) AS b, l_returnflag AS c FROM lineitem"
add("src_15_tsv", lambda s, d: R.tsv(s, lines_tsv(s, d), ["a", "b", "c"]), TSV)
add("src_16_keyed_lines", lambda s, d: R.keyed_lines(s, lines_tsv(s, d), 0).groupBy("key").agg(F.count("*").alias("n"), F.max(F.size("fields")).alias("width")), "SELECT CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n, 2 AS width FROM lineitem GROUP BY l_orderkey")
add("src_17_many_tsv_files", lambda s, d: R.tsv(s, [lines_tsv(s, d), lines_tsv(s, d)], ["a", "b", "c"]).groupBy("c").agg(F.count("*").alias("n")), "SELECT l_returnflag AS c, 2 * count(*) AS n FROM lineitem GROUP BY 1")
add("src_18_priors_by_mention", lambda s, d: R.keyed_lines(s, lines_tsv(s, d), 1).groupBy("key").agg(F.count("*").alias("n")), "SELECT CAST(l_linenumber AS VARCHAR) AS key, count(*) AS n FROM lineitem GROUP BY 1")
add("src_19_mention_classes", lambda s, d: R.tsv(s, lines_tsv(s, d), ["a", "b", "c"]).select(F.trim("b").alias("b"), "c").distinct(), "SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS b, l_returnflag AS c FROM lineitem")


def keyword_files(s, d) -> DataFrame:
    path = R.scratch(s)
    R.write_lines(parts(s, d).select("p_brand"), path, "p_brand")
    return R.lines(s, path, "part*").select("value").distinct()


add("src_20_keyword_lines", keyword_files, "SELECT DISTINCT lower(p_brand) AS value FROM part")
add("src_21_folder_scan", lambda s, d: R.json_lines(s, page_json(s, d)).select("url").distinct(), "SELECT DISTINCT url FROM pages")
add("src_22_part_files", lambda s, d: R.part_files(s, lines_tsv(s, d, "/batch/output_1"), ["a", "b", "c"]), TSV)


def headed(s, d) -> DataFrame:
    path = R.scratch(s)
    items(s, d).select("l_orderkey", "l_linenumber").write.option("sep", "\t").option("header", True).csv(path)
    return R.tsv(s, path, header=True).select(F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("n"))


add("src_23_headed_csv", headed, "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem")


def quoted(s, d) -> DataFrame:
    path = R.scratch(s)
    table(s, d, "documents").select("doc_id", "text").write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(f"{path}/document-data.csv")
    return R.csv_corpus(s, path, "document-data").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


add("src_25_csv_corpus", quoted, "SELECT doc_id, text FROM documents")

# Sinks: written, then read back.


def back(s, write, read) -> DataFrame:
    path = R.scratch(s)
    write(path)
    return read(path)


add("snk_01_edges", lambda s, d: back(s, lambda p: R.write_partitioned(I.edges(s, d).withColumn("k", F.lit(5)), p, "k"), lambda p: s.read.parquet(p).select("doc", "src", "dst", "proximity")), with_("edges") + "SELECT doc, src, dst, proximity FROM edges")
add("snk_02_pair_features", lambda s, d: back(s, lambda p: R.write_tsv(I.priors(s, d).select("mx", "mt", "func"), p), lambda p: R.tsv(s, p, ["mx", "mt", "func"])), with_("priors") + "SELECT CAST(mx AS VARCHAR) AS mx, CAST(mt AS VARCHAR) AS mt, func FROM priors")
add("snk_03_mention_features", lambda s, d: back(s, lambda p: I.surfaces(s, d).write.parquet(p), lambda p: s.read.parquet(p)), with_("surfaces") + "SELECT * FROM surfaces")
add("snk_06_lines", lambda s, d: back(s, lambda p: R.write_lines(I.surfaces(s, d), p, "surface"), lambda p: s.read.text(p)), with_("surfaces") + "SELECT surface AS value FROM surfaces")
add("snk_07_by_category", lambda s, d: back(s, lambda p: R.write_by_category(orders(s, d).select("o_orderkey", F.col("o_orderstatus").alias("category")), p), lambda p: s.read.json(p).groupBy("category").agg(F.count("*").alias("n"))), "SELECT o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1")
add("snk_09_surrogate_keys", lambda s, d: R.with_key(table(s, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source").where("doc_id is not null"), "SELECT doc_id, source FROM documents WHERE doc_id IS NOT NULL")


def written_entities(s, d) -> DataFrame:
    docs = orders(s, d).select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("doc_no"))
    ments = items(s, d).select(F.col("l_orderkey").alias("doc_no"), F.col("l_linenumber").alias("mention_id")).distinct().join(docs, "doc_no")
    tabs = table(s, d, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_nationkey").alias("table_no"))
    out = R.entities(docs, tabs, ments, ments.join(tabs, "page_id"))
    sizes = [df.agg(F.lit(n).alias("entity"), F.count("*").alias("n")) for n, df in out.items()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3])


add(
    "snk_10_entities",
    written_entities,
    "WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT 'document' AS entity, count(*) AS n FROM orders UNION ALL SELECT 'table', count(*) FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'mention', count(*) FROM m UNION ALL SELECT 'mention_table', count(*) FROM m JOIN customer ON c_custkey = o_custkey",
)
add("snk_11_journal", lambda s, d: R.not_yet(table(s, d, "pages").select("url"), table(s, d, "pages").where("page_id % 3 = 0").select("url")), "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
add("flt_07_url_dedup", lambda s, d: table(s, d, "pages").select("url").dropDuplicates(["url"]), "SELECT DISTINCT url FROM pages")

# Joins and sets.
add("jon_02_semi_join", lambda s, d: orders(s, d).join(items(s, d).where("l_discount > 0.08").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.08)")
lines = lambda s, d: items(s, d).select("l_orderkey", F.col("l_partkey").alias("p"))
add("jon_05_theta_self_join", lambda s, d: lines(s, d).alias("a").join(lines(s, d).alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.p") < F.col("b.p"))).groupBy("a.l_orderkey").agg(F.count("*").alias("n")), "SELECT a.l_orderkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1")
add("jon_06_cell_self_join", lambda s, d: I.grid(s, d).alias("a").join(I.grid(s, d).alias("b"), (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.r") == F.col("b.r")) & (F.col("a.c") < F.col("b.c"))).select(F.col("a.table_id").alias("t"), F.col("a.cell_id").alias("x"), F.col("b.cell_id").alias("y")), with_("grid") + "SELECT a.table_id AS t, a.cell_id AS x, b.cell_id AS y FROM grid a JOIN grid b ON a.table_id = b.table_id AND a.r = b.r AND a.c < b.c")
conv = lambda s, d: table(s, d, "conversations")


def overlap_join(s, d) -> DataFrame:
    docs = conv(s, d).where("turn % 2 = 0").select("conv_id", F.col("turn").alias("doc_no"), T.tokens("text").alias("doc_tokens"))
    tabs = conv(s, d).where("turn % 2 = 1").select("conv_id", F.col("turn").alias("table_no"), T.tokens("text").alias("table_tokens"))
    return pairs.overlap_links(docs, tabs, "conv_id").select("conv_id", "doc_no", "table_no", "overlap", "rank")


CONTENT = lambda c: f"list_filter({c}, lambda t: t <> '' AND NOT list_contains({STOP}, t))"
add(
    "jon_07_overlap_top_5",
    overlap_join,
    f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations), p AS (SELECT a.conv_id, a.turn AS doc_no, b.turn AS table_no, len(list_filter({CONTENT('a.w')}, lambda x: list_contains(b.w, x))) AS h, len({CONTENT('b.w')}) AS m FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn % 2 = 0 AND b.turn % 2 = 1),
    o AS (SELECT conv_id, doc_no, table_no, CASE WHEN greatest(h, m) = 0 THEN 1.0::DOUBLE ELSE h::DOUBLE / greatest(h, m) END AS overlap FROM p)
    SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, doc_no ORDER BY overlap DESC, table_no) AS INT) AS rank FROM o WHERE overlap > 0.2 QUALIFY row_number() OVER (PARTITION BY conv_id, doc_no ORDER BY overlap DESC, table_no) <= 5""",
)


def mention_tables(s, d) -> DataFrame:
    m = conv(s, d).where("turn % 2 = 0").select("conv_id", F.col("turn").alias("mention_id"), T.word_set("text").alias("words"))
    t = conv(s, d).where("turn % 2 = 1").select("conv_id", F.col("turn").alias("table_no"), T.word_set("text").alias("table_words"))
    return pairs.matching_tables(m, t, "conv_id").select("conv_id", "mention_id", "table_no", "n")


WORDS = r"list_distinct(list_filter(string_split_regex(lower(text), '[.,:?;/()\[\]\"''\-!&\s%$#\\]+'), lambda t: length(t) > 1 AND NOT list_contains(" + STOP + ", t)))"
MATCH = f"WITH t AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations), p AS (SELECT a.conv_id, a.turn AS mention_id, b.turn AS table_no, CAST(len(list_intersect(a.w, b.w)) AS INT) AS n FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn % 2 = 0 AND b.turn % 2 = 1)"
add("jon_08_matching_tables", mention_tables, MATCH + ", q AS (SELECT * FROM p WHERE n >= 2 QUALIFY n = max(n) OVER (PARTITION BY conv_id, mention_id)) SELECT * FROM q QUALIFY max(n) OVER (PARTITION BY conv_id) > 4")
add("jon_09_word_overlap", lambda s, d: conv(s, d).where("turn % 2 = 0").select("conv_id", F.col("turn").alias("a"), T.word_set("text").alias("x")).join(conv(s, d).where("turn % 2 = 1").select("conv_id", F.col("turn").alias("b"), T.word_set("text").alias("y")), "conv_id").where(F.size(F.array_intersect("x", "y")) > 1).select("conv_id", "a", "b"), MATCH + " SELECT conv_id, mention_id AS a, table_no AS b FROM p WHERE n > 1")
golds = lambda s, d: items(s, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("mx"), F.lit(1).alias("table_id"), F.lit("sum").alias("func"), F.concat_ws(",", "l_suppkey", "l_linenumber", F.lit("")).alias("cells"))
cands = lambda s, d: items(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("mx"), F.lit(1).alias("table_id"), F.lit("sum").alias("func"), F.concat_ws(",", "l_linenumber", "l_suppkey").alias("cells"))
add("jon_11_pair_gold", lambda s, d: pairs.with_gold(cands(s, d), golds(s, d)).select("doc_id", "mx", "cells", "gt"), "WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS mx, concat_ws(',', least(l_suppkey, l_linenumber), greatest(l_suppkey, l_linenumber)) AS cells, l_returnflag = 'R' AS g FROM lineitem) SELECT doc_id, mx, cells, CAST(EXISTS (SELECT 1 FROM c b WHERE b.g AND b.doc_id = c.doc_id AND b.mx = c.mx AND b.cells = c.cells) AS INT) AS gt FROM c")
add("jon_10_gold_lookup", lambda s, d: golds(s, d).select("doc_id", "mx", Q.sorted_cells("cells").alias("cells")).distinct().join(cands(s, d).select("doc_id", "mx", Q.sorted_cells("cells").alias("cells")).distinct(), ["doc_id", "mx", "cells"], "left"), "SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS mx, concat_ws(',', least(l_suppkey, l_linenumber), greatest(l_suppkey, l_linenumber)) AS cells FROM lineitem WHERE l_returnflag = 'R'")
add("jon_12_edges_with_priors", lambda s, d: I.edges(s, d).join(I.priors(s, d).where("prob > 0.9").select((F.col("mx") % 97).alias("doc")).distinct(), "doc", "left_semi").select("doc", "src", "dst"), with_("edges", "priors") + "SELECT doc, src, dst FROM edges WHERE doc IN (SELECT mx % 97 FROM priors WHERE prob > 0.9)")
add("jon_13_class_lookup", lambda s, d: I.priors(s, d).select("mx", "mt").join(I.priors(s, d).select("mx", "pred").distinct(), "mx"), with_("priors") + "SELECT mx, mt, pred FROM priors")
add("jon_14_split_by_ids", lambda s, d: I.priors(s, d).select("mx", "mt").join(orders(s, d).where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("mx")), "mx", "left_anti"), with_("priors") + "SELECT mx, mt FROM priors WHERE mx NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0)")
add("set_04_difference", lambda s, d: orders(s, d).select("o_custkey").exceptAll(orders(s, d).where("o_orderkey % 2 = 0").select("o_custkey")), "SELECT o_custkey FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0")
add("jon_15_keyword_matches", lambda s, d: parts(s, d).select("p_partkey", F.explode(F.split(F.lower("p_type"), " ")).alias("t")).join(s.createDataFrame([("steel",), ("brass",), ("small",)], "t string"), "t").groupBy("p_partkey").agg(F.count("*").alias("n")), "SELECT p_partkey, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS t FROM part) WHERE t IN ('steel', 'brass', 'small') GROUP BY 1")
add("set_01_bag_union", lambda s, d: orders(s, d).select(F.col("o_custkey").alias("k")).unionByName(table(s, d, "customer").select(F.col("c_custkey").alias("k"))), "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
add("set_02_distinct", lambda s, d: orders(s, d).select("o_custkey", "o_orderstatus").distinct(), "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")

# Statistics.
counted = lambda s, d: stats.counters(table(s, d, "pages").select(F.length("html").alias("chars"), (F.size(F.split("html", "<p>")) - 1).alias("paragraphs"), F.lit(1).alias("pages")), ["chars", "paragraphs", "pages"])
COUNTED = "WITH c AS (SELECT 'chars' AS name, length(html) AS value FROM pages UNION ALL SELECT 'paragraphs', len(string_split(html, '<p>')) - 1 FROM pages UNION ALL SELECT 'pages', 1 FROM pages) "
add("prj_24_page_counters", counted, COUNTED + "SELECT name, CAST(value AS BIGINT) AS value FROM c")
for n, how in (("agg_01_sum_by_key", "sum"), ("agg_02_min_by_key", "min"), ("agg_03_max_by_key", "max")):
    add(n, lambda s, d, how=how: stats.merged(counted(s, d), how), COUNTED + f"SELECT name, CAST({how}(value) AS BIGINT) AS value FROM c GROUP BY name")
add("agg_04_term_frequency", lambda s, d: stats.term_counts(table(s, d, "documents").select(T.tokens("text").alias("t")), "t"), f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term")
add("prj_25_header_terms", lambda s, d: stats.term_counts(parts(s, d).select(F.split(F.lower("p_type"), " ").alias("t")), "t"), "SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(lower(p_type), ' '))) AS term FROM part) GROUP BY term")
add("agg_05_tokens_by_group", lambda s, d: table(s, d, "documents").select("lang", F.explode(T.tokens("text")).alias("t")).where(~F.col("t").isin("", *T.STOP_WORDS)).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("t").alias("different")), f"SELECT lang, count(*) AS n, count(DISTINCT t) AS different FROM (SELECT lang, unnest({CONTENT(TOKENS)}) AS t FROM documents) GROUP BY lang")
FREQ = f"SELECT lang, term, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({CONTENT(TOKENS)}) AS term FROM documents) GROUP BY ALL)) WHERE rank <= 50"
add("agg_06_most_frequent", lambda s, d: stats.most_frequent(table(s, d, "documents").select("lang", T.tokens("text").alias("t")), "lang", "t", stop=T.STOP_WORDS), FREQ)
add("snk_04_frequent_words", lambda s, d: back(s, lambda p: stats.most_frequent(table(s, d, "documents").select("lang", T.tokens("text").alias("t")), "lang", "t", stop=T.STOP_WORDS).write.parquet(p), lambda p: s.read.parquet(p)), FREQ)
add("snk_05_term_counts", lambda s, d: back(s, lambda p: stats.term_counts(parts(s, d).select(F.split("p_type", " ").alias("t")), "t").write.parquet(p), lambda p: s.read.parquet(p)), "SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS term FROM part) GROUP BY term")
add("prj_26_relation_words", lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("quality", F.explode(T.tokens("text")).alias("t")).groupBy("quality", "t").agg(F.count("*").alias("n")), f"SELECT quality, t, count(*) AS n FROM (SELECT quality, unnest({TOKENS}) AS t FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
add("agg_07_corpus_totals", lambda s, d: table(s, d, "documents").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("total"), F.count("*").alias("docs")), "SELECT min(n_chars) AS least, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS total, count(*) AS docs FROM documents")
add("agg_21_by_category", lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "SELECT source, count(*) AS n FROM documents GROUP BY source")
KW = {"metal": ["steel", "brass", "copper"], "size": ["small", "large", "medium"], "finish": ["plated", "polished", "brushed"]}
add(
    "str_19_category",
    lambda s, d: stats.category(parts(s, d).select("p_partkey", F.split("p_type", " ").alias("terms")), KW).select("p_partkey", "category"),
    "WITH n AS (SELECT p_partkey, " + ", ".join(f"len(list_filter(string_split(lower(p_type), ' '), lambda t: list_contains({ws}, t))) AS {k}" for k, ws in KW.items()) + " FROM part) SELECT p_partkey, CASE WHEN greatest(metal, size, finish) = 0 THEN '' WHEN metal = greatest(metal, size, finish) THEN 'metal' WHEN size = greatest(metal, size, finish) THEN 'size' ELSE 'finish' END AS category FROM n",
)
add("agg_19_keyword_classes", lambda s, d: parts(s, d).select("p_partkey", stats.keyword_class_counts(F.split("p_type", " "), KW).alias("k")).select("p_partkey", "k.*"), "SELECT p_partkey, " + ", ".join(f"CAST(len(list_filter(string_split(lower(p_type), ' '), lambda t: list_contains({ws}, t))) AS INT) AS {k}" for k, ws in KW.items()) + " FROM part")
add("jsn_01_json_fields", lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.length("props").alias("n")), "SELECT event_id, json_extract_string(props, '$.page') AS page, CAST(length(props) AS INT) AS n FROM events")

# Quantities in running text.
report = lambda s, d: I.surfaces(s, d).select("id", F.concat(F.lit("Revenue rose to "), "surface", F.lit(" on March 3, 2014 (see table 2.1), up 5% from 1999.")).alias("text"))
add("prj_09_mentions", lambda s, d: recognise.extract(report(s, d), "id"))
add("prj_10_mentions_of_documents", lambda s, d: recognise.extract(table(s, d, "documents").select("doc_id", "text"), "doc_id"))

# Pages with tables made from the grid: header row, a label and a value a cell.


def table_pages(s, d) -> DataFrame:
    cell = F.concat(F.lit("<td>$"), F.floor(F.col("cents") / 100).cast("string"), F.lit("</td>"))
    rows = I.grid(s, d).groupBy("table_id", "r").agg(F.array_join(F.array_sort(F.collect_list(F.struct("c", cell.alias("h")))).getField("h"), "").alias("h"))
    rows = rows.select("table_id", "r", F.concat(F.lit("<tr><th>Row "), F.expr("char(64 + r)"), F.lit("</th>"), "h", F.lit("</tr>")).alias("h"))
    body = rows.groupBy("table_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", "h"))).getField("h"), "").alias("h"))
    return body.select(F.col("table_id").alias("page_id"), F.concat(F.lit("<html><title> A  page </title><script>x<td></script><p>Before.</p><table><caption>Revenue ($ million)</caption>"), "h", F.lit("</table><p>After.</p></html>")).alias("html"))


grid_of = lambda s, d: html.grid_cells(table_pages(s, d))
SLOTS = with_("grid") + "SELECT table_id AS page_id, 1 AS table_id, r - 1 AS r, c, CAST((r - 1) * (SELECT max(c) FROM grid g WHERE g.table_id = grid.table_id) + c AS INT) AS cell_id, false AS is_header, '$' || (cents // 100) AS text FROM grid UNION ALL SELECT DISTINCT table_id, 1, r - 1, 0, -r, true, 'row ' || lower(chr(CAST(64 + r AS INT))) FROM grid"
add("prj_03_grid", grid_of, SLOTS)
add("prj_01_page_parse", lambda s, d: html.parsed(table_pages(s, d)).select("page_id", "title", "content", F.size("tables").alias("n")), with_("grid") + "SELECT DISTINCT table_id AS page_id, 'A page' AS title, 'Before.' || chr(10) || chr(10) || 'After.' AS content, 1 AS n FROM grid")
add("prj_02_page_parse_of_pages", lambda s, d: html.parsed(table(s, d, "pages")).select("page_id", "title", F.size("tables").alias("n")))
add("prj_04_column_count", lambda s, d: grid_of(s, d).groupBy("page_id", "r").agg((F.max("c") + 1).alias("n")), with_("grid") + "SELECT table_id AS page_id, r - 1 AS r, max(c) + 1 AS n FROM grid GROUP BY table_id, r")
add("prj_08_page_documents", lambda s, d: html.parsed(table_pages(s, d)).where(F.size("tables") > 0).select("page_id", F.posexplode(F.split("content", r"\n+")).alias("block_no", "text")), with_("grid") + "SELECT DISTINCT table_id AS page_id, n AS block_no, CASE n WHEN 0 THEN 'Before.' ELSE 'After.' END AS text FROM grid, (VALUES (0), (1)) v(n)")
add("prj_14_cell_mentions", lambda s, d: html.cell_mentions(grid_of(s, d)).select("page_id", "cell_id", "v", "prec", "own_scale", "own_unit"), with_("grid") + "SELECT table_id AS page_id, CAST((r - 1) * (SELECT max(c) FROM grid g WHERE g.table_id = grid.table_id) + c AS INT) AS cell_id, CAST(cents // 100 AS DOUBLE) AS v, 0 AS prec, 1.0::DOUBLE AS own_scale, '$' AS own_unit FROM grid")
add("flt_03_table_admission", lambda s, d: html.table_sizes(grid_of(s, d)).select("page_id", "n_rows", "n_cols", "admitted"), with_("grid") + "SELECT table_id AS page_id, max(r) AS n_rows, max(c) + 1 AS n_cols, max(r) BETWEEN 2 AND 100 AS admitted FROM grid GROUP BY table_id")
add("flt_04_table_admission_variant", lambda s, d: html.table_sizes(grid_of(s, d)).where("n_rows between 2 and 20 and n_cols between 2 and 20 and n_quantity >= 0.4 * n_filled").select("page_id"), with_("grid") + "SELECT table_id AS page_id FROM grid GROUP BY table_id HAVING max(r) BETWEEN 2 AND 20 AND max(c) + 1 BETWEEN 2 AND 20")
add("flt_08_table_size_cap", lambda s, d: html.table_sizes(grid_of(s, d)).where("n_rows * n_cols <= 150").select("page_id"), with_("grid") + "SELECT table_id AS page_id FROM grid GROUP BY table_id HAVING max(r) * (max(c) + 1) <= 150")
add("ctx_01_cell_scale_and_unit", lambda s, d: html.with_context(html.cell_mentions(grid_of(s, d)), grid_of(s, d)).groupBy("page_id").agg(F.max("scale").alias("scale"), F.max("unit").alias("unit"), F.count("*").alias("n")), with_("grid") + "SELECT table_id AS page_id, 1.0::DOUBLE AS scale, '$' AS unit, count(*) AS n FROM grid GROUP BY 1")
add("ctx_03_table_scale_and_unit", lambda s, d: html.parsed(table_pages(s, d)).select("page_id", F.explode("tables").alias("t")).select("page_id", Q.scale_of("t.caption").alias("scale"), Q.unit_of("t.caption").alias("unit")), with_("grid") + "SELECT DISTINCT table_id AS page_id, 1e6::DOUBLE AS scale, '$' AS unit FROM grid")
add("ctx_04_context_words", lambda s, d: html.context_words(grid_of(s, d)).select("page_id", "axis", "line", F.array_join("words", ",").alias("words")))
add("ctx_05_table_context", lambda s, d: html.context_words(grid_of(s, d)).where("axis = 'row' and line = 0 or axis = 'col' and line = 0").groupBy("page_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("n")))
add("ctx_06_document_context", lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(T.content_tokens("text"), " ").alias("x")), f"SELECT item_id, array_to_string({CONTENT(TOKENS)}, ' ') AS x FROM benchmark")
add(
    "ctx_09_exact_matches",
    lambda s, d: neighbours(s, d).withColumn("x", S.jaro("a", "b")).groupBy((F.col("id") % 100).alias("g")).agg(F.count_if(F.col("x") > 0.9).alias("n")),
    with_("surfaces") + f"SELECT id % 100 AS g, count(*) FILTER (WHERE jaro_similarity(a, b) > 0.9) AS n FROM {SURF2} GROUP BY 1",
)
add("ctx_10_gold_relation", lambda s, d: I.priors(s, d).select("mx").distinct().join(pairs.first_gold(I.priors(s, d).where("gt = 1").select("mx", "func", F.col("mt").alias("seq")), ["mx"]), "mx", "left").select("mx", F.coalesce("func", F.lit("None")).alias("rel")), with_("priors") + "SELECT DISTINCT p.mx, coalesce(f.func, 'None') AS rel FROM priors p LEFT JOIN (SELECT mx, func FROM priors WHERE gt = 1 QUALIFY row_number() OVER (PARTITION BY mx ORDER BY CAST(func = 'same' AS INT), mt) = 1) f ON p.mx = f.mx")
add("flt_17_caption_terms", lambda s, d: parts(s, d).where(F.exists(F.split("p_type", " "), lambda t: F.contains(F.lower(t), F.lit("stand")))).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'stand')")
add("flt_16_selection", lambda s, d: table(s, d, "documents").where(F.size(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))) > 0).select("doc_id"), r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\d+')")
add("srt_02_mentions_by_offset", lambda s, d: items(s, d).select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber")).alias("seq")), "SELECT l_orderkey, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS INT) AS seq FROM lineitem")
add("prj_18_all_edges", lambda s, d: I.edges(s, d).select(F.concat_ws("\t", F.col("doc").cast("string"), "src", "dst").alias("line")), with_("edges") + "SELECT concat_ws(chr(9), CAST(doc AS VARCHAR), src, dst) AS line FROM edges")

# Models.


def features(s, d) -> DataFrame:
    df = I.priors(s, d).select("mx", "mt", "prob", "sim", (F.col("func") == "same").cast("double").alias("same"), F.col("gt").cast("double").alias("label"))
    return model.weighted(model.folds(df, "mx"), "label")


FEATURES = ["prob", "sim", "same"]
add("mll_01_pair_scoring", lambda s, d: model.scored(model.train(features(s, d).where("fold > 0").withColumnRenamed("prob", "p0"), ["p0", "sim", "same"]), features(s, d).withColumnRenamed("prob", "p0")).select("mx", "mt", "prob"))
add("mll_02_grouped_cross_validation", lambda s, d: model.scored(model.tuned(model.folds(features(s, d).withColumnRenamed("prob", "p0"), "mx", 3), ["p0", "sim", "same"], "fold", 3), features(s, d).withColumnRenamed("prob", "p0")).select("mx", "mt", "prob"))
add("mll_05_dev_sample", lambda s, d: I.priors(s, d).where(F.pmod(F.xxhash64("mx", F.lit(3377)), F.lit(9)) == 0).select("mx", "mt"))
add("mll_09_factor_index", lambda s, d: model.indexed(I.priors(s, d).select("mx", "mt", "func"), "func", "i").select("mx", "mt", "i"), with_("priors") + "SELECT mx, mt, CAST(list_position(['dif', 'percentage', 'rat', 'same', 'sum'], func) - 1 AS DOUBLE) AS i FROM priors")
add("mll_10_importance", lambda s, d: s.createDataFrame(model.importances(model.train(features(s, d), FEATURES), FEATURES), "feature string, importance double"))


def mention_classes(s, d) -> DataFrame:
    df = I.priors(s, d).select("mx", "mt", "prob", "sim", F.col("pred").alias("name"))
    df = model.indexed(df, "name", "label").withColumn("weight", F.lit(1.0)).withColumnRenamed("prob", "p0")
    fitted = model.train(df, ["p0", "sim"])
    return fitted.transform(df).select("mx", "mt", "prediction")


add("mll_06_mention_classes", mention_classes)
add("ctx_11_feature_assembly", lambda s, d: I.surfaces(s, d).select("id", F.coalesce(Q.unit_of("surface"), F.lit("$")).alias("unit"), F.when(Q.scale_of("surface") != 1, Q.scale_of("surface")).otherwise(1000.0).alias("scale")).groupBy("unit", "scale").agg(F.count("*").alias("n")))
