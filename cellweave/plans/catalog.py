"""One query per operator, with the same rows as SQL where SQL can say it.

Names follow the inventory: ``<group>_<number>_<short name>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import quantity as Q
from cellweave.functions import similarity as S
from cellweave.functions import text as T
from cellweave.operators import evaluate, filtering, graph, pairs, stats, virtual
from cellweave.plans import inputs as I
from cellweave.plans.inputs import table, with_

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Stop words as an SQL list.
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def add(name: str, fn: Callable, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def scalar(name: str, expr: Callable, sql: str) -> None:
    """A scalar function over the quantity surfaces."""
    add(name, lambda s, d: I.surfaces(s, d).select("id", expr("surface").alias("x")), with_("surfaces") + f"SELECT id, {sql} AS x FROM surfaces")


def listing(name: str, expr: Callable, sql: str, source: str = "documents", key: str = "doc_id") -> None:
    """An array function over texts, its items joined by a bar."""
    add(name, lambda s, d: table(s, d, source).select(key, F.array_join(expr("text"), "|").alias("x")), f"SELECT {key}, array_to_string({sql}, '|') AS x FROM {source}")


def r6(x):
    """Six decimals by one rule in both engines, for sums whose order is open."""
    return F.floor(x * 1e6 + 0.5) / 1e6


R6 = "floor(({}) * 1e6 + 0.5) / 1e6"

# Text functions.
TOKENS = r"string_split_regex(lower(text), '[\s.,?;()\"''!]+')"
listing("str_01_tokenise", T.tokens, TOKENS)
listing("str_02_tokens_without_stop_words", T.content_tokens, f"list_filter({TOKENS}, lambda t: t <> '' AND NOT list_contains({STOP}, t))")
WORDS = r"string_split_regex(lower(text), '[.,:?;/()\[\]\"''\-!&\s%$#\\]+')"
listing("str_03_word_set", T.word_set, f"list_sort(list_distinct(list_filter({WORDS}, lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))))")
add(
    "str_04_stem",
    lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(T.content_tokens("text")).alias("word")).distinct().withColumn("stem", T.stem("word")),
)
PHRASE = r"string_split_regex(lower(text), '[\s.,?;()\"'']')"
listing(
    "str_06_fast_noun_phrases",
    T.phrases,
    f"""list_sort(list_distinct(list_filter(list_transform(range(1, len({PHRASE})), lambda i:
        CASE WHEN {PHRASE}[i] <> '' AND {PHRASE}[i + 1] <> '' AND NOT list_contains({STOP}, {PHRASE}[i]) AND NOT list_contains({STOP}, {PHRASE}[i + 1])
        THEN {PHRASE}[i] || ' ' || {PHRASE}[i + 1] END), lambda p: p IS NOT NULL)))""",
    "benchmark",
    "item_id",
)
SURF2 = "(SELECT a.id, a.surface AS a, b.surface AS b FROM surfaces a JOIN surfaces b ON b.id = a.id + 1)"


def neighbours(s, d) -> DataFrame:
    x = I.surfaces(s, d).select("id", F.col("surface").alias("a"))
    y = I.surfaces(s, d).select((F.col("id") - 1).alias("id"), F.col("surface").alias("b"))
    return x.join(y, "id")


def two(name: str, expr: Callable, sql: str) -> None:
    """A similarity of the surfaces of neighbouring ids."""
    add(name, lambda s, d: neighbours(s, d).select("id", expr("a", "b").alias("x")), with_("surfaces") + f"SELECT id, {sql} AS x FROM {SURF2}")


LEV = "levenshtein(a, b)"
two("str_07_edit_similarity", S.edit_similarity, f"CASE WHEN {LEV} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / ({LEV} + 0.2::DOUBLE) END")
two(
    "str_08_unit_similarity",
    S.unit_similarity,
    f"CASE WHEN {LEV} >= least(length(a), length(b)) THEN -1.0::DOUBLE WHEN {LEV} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / ({LEV} + 0.2::DOUBLE) END",
)
two(
    "str_08_unit_similarity_legacy",
    lambda a, b: S.unit_similarity(a, b, 0.0),
    f"CASE WHEN {LEV} >= least(length(a), length(b)) THEN 0.0::DOUBLE WHEN {LEV} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / ({LEV} + 0.2::DOUBLE) END",
)
two("str_09_jaro", lambda a, b: r6(S.jaro(a, b)), R6.format("jaro_similarity(a, b)"))
add(
    "str_10_nearest_phrase",
    lambda s, d: neighbours(s, d).select("id", S.nearest_phrase(F.split("a", " "), F.split("b", " ")).alias("x")),
    with_("surfaces")
    + f"""SELECT id, CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (m + 0.2::DOUBLE) END AS x FROM (
        SELECT id, list_min(flatten(list_transform(string_split(a, ' '), lambda p: list_transform(string_split(b, ' '), lambda q: levenshtein(p, q))))) AS m FROM {SURF2})""",
)

# Quantity functions.
NUM = r"regexp_extract(surface, '(-)?(\d+(?:[, ]\d+)*(?:\.\d+)?)', 2)"
VALUE = rf"CASE WHEN regexp_full_match({NUM}, '\d+,\d') THEN replace({NUM}, ',', '.') ELSE regexp_replace({NUM}, '[, ]', '', 'g') END"
HAS = lambda *ws: "(" + " OR ".join(f"contains(surface, '{w}')" for w in ws) + ")"
MONEY = r"^\p{Sc}\d+(?:[.,]\d+)*"
CASES = [
    (HAS("million", "mega"), "1e6", None), (HAS("billion", "giga"), "1e9", None), (HAS("thousand", "kilo"), "1e3", None), (HAS("hundred"), "100.0", None),
    (r"regexp_matches(surface, '\bcents?\b')", "0.01", "$"), (f"regexp_matches(surface, '{MONEY}bn?$')", "1e9", None),
    (f"regexp_matches(surface, '{MONEY}mn?$')", "1e6", None), (f"regexp_matches(surface, '{MONEY}k$')", "1e3", None),
    (r"regexp_matches(surface, '^\(?\p{Sc}?000''?s')", "1e3", None),
    *((HAS(sign + letter), v, u) for sign, u in (("$", "$"), ("£", "pound")) for letter, v in (("m", "1e6"), ("b", "1e9"), ("k", "1e3"))),
]
SCALE = "CASE " + " ".join(f"WHEN {c} THEN {v}::DOUBLE" for c, v, _ in CASES) + " ELSE 1.0::DOUBLE END"
UNIT = (
    "coalesce(CASE " + " ".join(f"WHEN {c} THEN {repr(u) if u else 'NULL'}" for c, _, u in CASES) + " END, CASE "
    f"WHEN {HAS('$', 'usd', 'dollar')} THEN '$' WHEN {HAS('eur', '€')} THEN 'eur' WHEN {HAS('£', 'pound')} THEN 'pound' WHEN {HAS('%', 'percent', 'per cent')} THEN '%' END)"
)
scalar("num_01_parse_number", Q.value_text, VALUE)
scalar("num_01_value", Q.value, f"TRY_CAST({VALUE} AS DOUBLE)")
scalar("num_01_sign", Q.negative, r"regexp_extract(surface, '(-)?(\d+(?:[, ]\d+)*(?:\.\d+)?)', 1) = '-'")
scalar("num_02_precision", Q.precision, rf"length(regexp_extract({VALUE}, '\.(\d+)$', 1))::INT")
scalar("str_11_scale", Q.scale_of, SCALE)
scalar("str_11_unit", Q.unit_of, UNIT)
scalar("str_13_simple_unit", Q.simple_unit, "CASE WHEN contains(surface, '%') THEN '%' WHEN contains(surface, '$') THEN '$' ELSE 'other' END")
scalar(
    "str_13_simple_scale",
    Q.simple_scale,
    f"CASE WHEN {HAS('million')} THEN 1e6::DOUBLE WHEN {HAS('thousand')} THEN 1e3::DOUBLE WHEN {HAS('hundred')} THEN 100::DOUBLE WHEN {HAS('billion')} THEN 1e9::DOUBLE ELSE 0::DOUBLE END",
)
add(
    "num_03_scaled_value",
    lambda s, d: I.surfaces(s, d).select("id", Q.scaled_value(Q.value("surface"), F.lit(None).cast("double"), Q.unit_of("surface"), Q.scale_of("surface")).alias("x")),
    with_("surfaces") + f"SELECT id, CASE WHEN {UNIT} IS NOT DISTINCT FROM '%' THEN TRY_CAST({VALUE} AS DOUBLE) ELSE TRY_CAST({VALUE} AS DOUBLE) * {SCALE} END AS x FROM surfaces",
)
add(
    "prj_13_mention_construction",
    lambda s, d: I.surfaces(s, d).select(
        "id", T.squeeze("surface").alias("surface"), Q.value("surface").alias("value"), Q.precision("surface").alias("prec"), Q.scale_of("surface").alias("scale"), Q.unit_of("surface").alias("unit")
    ),
    with_("surfaces")
    + rf"SELECT id, lower(trim(regexp_replace(surface, '\s+', ' ', 'g'))) AS surface, TRY_CAST({VALUE} AS DOUBLE) AS value, length(regexp_extract({VALUE}, '\.(\d+)$', 1))::INT AS prec, {SCALE} AS scale, {UNIT} AS unit FROM surfaces",
)
HEADERS = ["revenue ($ million)", "share %", "total", "price in cents", "($000s)", "(000's omitted)", "$000's", "x000000s", "%", "avg price", "diff", "year", "£m", "$k", "eur thousand", "change in %", ""]


def headers(s, d) -> DataFrame:
    return table(s, d, "nation").select("n_nationkey").withColumn("surface", F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("n_nationkey") % len(HEADERS) + 1).cast("int")))


HEADERS_SQL = "(SELECT n_nationkey, [" + ", ".join("'" + h.replace("'", "''") + "'" for h in HEADERS) + f"][n_nationkey % {len(HEADERS)} + 1] AS surface FROM nation)"


def header(name: str, expr: Callable, sql: str) -> None:
    add(name, lambda s, d: headers(s, d).select("n_nationkey", expr("surface").alias("x")), f"SELECT n_nationkey, {sql} AS x FROM {HEADERS_SQL}")


header("str_11_header_scale", Q.scale_of, SCALE)
header("str_11_header_unit", Q.unit_of, UNIT)
header("str_12_zero_suffix_scale", Q.zero_scale, r"CASE WHEN regexp_matches(surface, '\D000(?:''s|s)') THEN 1e3::DOUBLE WHEN regexp_matches(surface, '\D000000(?:''s|s)') THEN 1e6::DOUBLE ELSE 1::DOUBLE END")
header("flt_11_aggregate_header", Q.aggregate_header, "regexp_matches(surface, 'total|change|percent|average|avg|diff') OR surface = '%'")
header("str_14_relation_of_name", Q.relation_of, "CASE WHEN contains(surface, 'rat') THEN 'rat' WHEN contains(surface, 'perc') THEN 'percentage' WHEN contains(surface, 'dif') THEN 'dif' WHEN contains(surface, 'avg') THEN 'avg' ELSE 'same' END")
header("prj_05_cell_text", T.squeeze, r"lower(trim(regexp_replace(surface, '\s+', ' ', 'g')))")
QN = r"\(?[+-]?\d+(?:[., ]\d+)*\)?"
scalar("flt_01_quantity", Q.is_quantity, r"regexp_full_match(trim(surface), '\(?[+-]?\p{Sc}?\d+(?:[., ]\d+)*%?\p{Sc}?\)?|" + QN + r".{1,10}|.{1,10}" + QN + r"|.{1,10}" + QN + r".{1,10}')")
add(
    "flt_02_year",
    lambda s, d: table(s, d, "orders").select("o_orderkey", Q.is_year((F.col("o_orderkey") % 400 + 1800).cast("string")).alias("x")),
    r"SELECT o_orderkey, regexp_full_match(CAST(o_orderkey % 400 + 1800 AS VARCHAR), '19\d{2}|20[01]\d') AS x FROM orders",
)
RAW = r"trim(regexp_extract(surface, '\d+(?:[, ]\d+)*(?:\.\d+)?', 0))"
RV = f"regexp_replace({RAW}, '[, ]', '', 'g')"
scalar(
    "str_17_truncate",
    Q.truncated,
    rf"""CASE WHEN {RAW} = '' THEN surface WHEN regexp_matches({RV}, '\.\d\d+$') THEN replace(surface, {RAW}, regexp_extract({RV}, '^\d+\.\d', 0))
      WHEN contains({RV}, '.') THEN replace(surface, {RAW}, regexp_extract({RV}, '^\d+', 0))
      WHEN length({RV}) > 2 THEN replace(surface, {RAW}, {RV}[1:length({RV}) - length({RV}) // 2] || repeat('0', length({RV}) // 2)) ELSE surface END""",
)
scalar(
    "str_18_approximate",
    Q.approximated,
    f"""CASE WHEN {RAW} = '' THEN surface WHEN contains({RV}, '.') THEN replace(surface, {RAW}, CAST(CAST(floor(CAST({RV} AS DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) || '.0')
      ELSE replace(surface, {RAW}, CAST(CAST(floor(CAST({RV} AS DOUBLE) / power(10, length({RV}) // 2) + 0.5) * power(10, length({RV}) // 2) AS BIGINT) AS VARCHAR)) END""",
)
two("str_16_pair_type", Q.pair_type, "CASE WHEN a = b THEN 'exact' WHEN starts_with(a, b) OR starts_with(b, a) THEN 'truncated' ELSE 'approximate' END")
add(
    "str_15_full_name",
    lambda s, d: I.grid(s, d).select("table_id", "cell_id", Q.full_name("table_id", "cell_id", F.when(F.col("r") == 1, "sum")).alias("x")),
    with_("grid") + "SELECT table_id, cell_id, concat_ws('.', CAST(table_id AS VARCHAR), CAST(cell_id AS VARCHAR), CASE WHEN r = 1 THEN 'sum' END) AS x FROM grid",
)
CELLS = "concat_ws(',', CAST(l_partkey % 50 AS VARCHAR), CAST(l_suppkey % 7 AS VARCHAR), CAST(l_linenumber AS VARCHAR), '')"
cells_of = lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(CELLS.replace("VARCHAR", "STRING")).alias("cells"))
LIST = f"list_sort(list_transform(list_filter(string_split({CELLS}, ','), lambda x: x <> ''), lambda x: CAST(x AS INT)))"
add("srt_03_sort_cells", lambda s, d: cells_of(s, d).select("l_orderkey", "l_linenumber", Q.sorted_cells("cells").alias("x")), f"SELECT l_orderkey, l_linenumber, array_to_string({LIST}, ',') AS x FROM lineitem")
add("arr_03_cell_list", lambda s, d: cells_of(s, d).select("l_orderkey", "l_linenumber", F.size(Q.cell_list("cells")).alias("n"), F.element_at(Q.cell_list("cells"), 1).alias("first")), f"SELECT l_orderkey, l_linenumber, CAST(len({LIST}) AS INT) AS n, {LIST}[1] AS first FROM lineitem")
add(
    "num_06_gaps",
    lambda s, d: neighbours(s, d).select("id", r6(Q.scale_gap(Q.scale_of("a"), Q.scale_of("b"))).alias("scale_gap"), F.abs(Q.precision("a") - Q.precision("b")).alias("prec_gap")),
    with_("surfaces") + f""", f AS (SELECT id, {SCALE} AS s, length(regexp_extract({VALUE}, '\\.(\\d+)$', 1))::INT AS p FROM surfaces)
      SELECT a.id, {R6.format('abs(log10(a.s) - log10(b.s))')} AS scale_gap, abs(a.p - b.p) AS prec_gap FROM f a JOIN f b ON b.id = a.id + 1""",
)
add(
    "num_07_function_similarity",
    lambda s, d: I.priors(s, d).select("mx", "mt", S.function_similarity("func", "pred").alias("x"), S.live_function_similarity(F.when(F.col("gt") == 1, F.col("pred")), "func", F.when(F.col("mt") % 2 == 0, "%")).alias("live")),
    with_("priors") + "SELECT mx, mt, CASE WHEN func = pred OR (func = 'rat' AND pred = 'dif') THEN 1 ELSE -1 END AS x, CASE WHEN func = 'percentage' AND gt = 0 AND mt % 2 = 0 THEN 1 ELSE 0 END AS live FROM priors",
)
add(
    "num_08_entropy",
    lambda s, d: I.priors(s, d).groupBy("mx").agg(F.array_sort(F.collect_list("prob")).alias("p")).select("mx", r6(Q.entropy("p")).alias("entropy")),
    with_("priors") + f", t AS (SELECT *, prob / sum(prob) OVER (PARTITION BY mx) AS p FROM priors) SELECT mx, {R6.format('-sum(p * ln(p))')} AS entropy FROM t GROUP BY mx",
)
add(
    "num_11_rounding",
    lambda s, d: I.grid(s, d).select("table_id", "cell_id", Q.round2(F.col("v") / 3).alias("x"), F.abs(-F.col("v")).alias("y"), F.pow(F.lit(10.0), F.col("c")).alias("z")),
    with_("grid") + "SELECT table_id, cell_id, floor(v / 3 * 100 + 0.5) / 100 AS x, abs(-v) AS y, power(10.0::DOUBLE, c) AS z FROM grid",
)
add(
    "num_12_standardise",
    lambda s, d: I.priors(s, d).join(F.broadcast(I.priors(s, d).agg(F.avg("prob").alias("m"), F.stddev_samp("prob").alias("sd"))), F.lit(True)).select("mx", "mt", r6((F.col("prob") - F.col("m")) / F.col("sd")).alias("x")),
    with_("priors") + f"SELECT mx, mt, {R6.format('(prob - m) / sd')} AS x FROM priors, (SELECT avg(prob) AS m, stddev_samp(prob) AS sd FROM priors)",
)
add(
    "num_13_blend",
    lambda s, d: I.edges(s, d).select("doc", "src", "dst", (0.9 * F.col("proximity") + 0.1 * F.col("surface_sim")).alias("w")),
    with_("edges") + "SELECT doc, src, dst, 0.9::DOUBLE * proximity + 0.1::DOUBLE * surface_sim AS w FROM edges",
)
# Token overlaps of neighbouring benchmark items.
pairs_of = lambda s, d: table(s, d, "benchmark").select("item_id", T.tokens("text").alias("a")).join(table(s, d, "benchmark").select((F.col("item_id") - 1).alias("item_id"), T.tokens("text").alias("b")), "item_id")
ITEMS = f"(SELECT x.item_id, x.t AS a, y.t AS b FROM (SELECT item_id, {TOKENS} AS t FROM benchmark) x JOIN (SELECT item_id, {TOKENS} AS t FROM benchmark) y ON y.item_id = x.item_id + 1)"
CONTENT = lambda c: f"list_filter({c}, lambda t: t <> '' AND NOT list_contains({STOP}, t))"
HITS = f"len(list_filter({CONTENT('a')}, lambda t: list_contains(b, t)))"
add(
    "num_10_overlap",
    lambda s, d: pairs_of(s, d).select("item_id", S.overlap("a", "b").alias("x"), S.jaccard("a", "b").alias("jaccard")),
    f"""SELECT item_id, CASE WHEN greatest(h, m) = 0 THEN 1.0::DOUBLE ELSE h::DOUBLE / greatest(h, m) END AS x, coalesce(h::DOUBLE / nullif(n + m - h, 0), 0) AS jaccard
      FROM (SELECT item_id, {HITS} AS h, len({CONTENT('a')}) AS n, len({CONTENT('b')}) AS m FROM {ITEMS})""",
)
add(
    "set_03_overlap_size",
    lambda s, d: pairs_of(s, d).select("item_id", S.set_overlap("a", "b").alias("x"), F.size(F.array_union("a", "b")).alias("u"), F.size(F.array_except("a", "b")).alias("e")),
    f"SELECT item_id, CAST(len(list_intersect(a, b)) AS INT) AS x, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS u, CAST(len(list_filter(list_distinct(a), lambda t: NOT list_contains(b, t))) AS INT) AS e FROM {ITEMS}",
)
add(
    "num_09_weighted_overlap",
    lambda s, d: pairs_of(s, d).select("item_id", r6(S.weighted_overlap(F.lit(40), "a", "b", 1, 0.025)).alias("x")),
    f"""SELECT i.item_id, {R6.format('coalesce(sum(greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(pos - (k - 1)) * 0.025::DOUBLE)) FILTER (WHERE t <> $$$$ AND NOT list_contains(' + STOP + ', t) AND list_contains(b, t)), 0) / nullif(max(m), 0)')} AS x
      FROM (SELECT item_id, a, b, len({CONTENT('b')}) AS m,
        least(coalesce(list_position(list_transform(range(0, len(a) + 1), lambda n: list_sum(list_transform(a[1:n], lambda t: length(t) + CASE WHEN length(t) > 1 THEN 1 ELSE 0 END)) >= 40), true) - 1, len(a)), len(a) - 1) AS pos
        FROM {ITEMS}) i, LATERAL (SELECT unnest(a) AS t, unnest(range(1, len(a) + 1)) AS k) GROUP BY i.item_id""".replace("$$$$", "''"),
)
# Token frames around a middle token.
frames = lambda s, d: table(s, d, "documents").select("doc_id", T.tokens("text").alias("t")).select("doc_id", F.expr("slice(t, 1, size(t) div 2)").alias("before"), F.expr("slice(t, size(t) div 2 + 2, size(t))").alias("after"))
HALF = f"(SELECT doc_id, t[1:len(t) // 2] AS before, t[len(t) // 2 + 2:] AS after FROM (SELECT doc_id, {TOKENS} AS t FROM documents))"
FRAME = "list_concat(before[greatest(len(before) - 4, 1):], after[1:5])"
add("win_08_token_frame", lambda s, d: frames(s, d).select("doc_id", F.array_join(Q.frame("before", "after"), "|").alias("x")), f"SELECT doc_id, array_to_string({FRAME}, '|') AS x FROM {HALF}")


def map_sql(known: dict[str, object]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {repr(v) if isinstance(v, str) else str(v) + '::DOUBLE'}" for k, v in known.items()) + "}"


FIRST = lambda known: f"list_filter(list_transform({FRAME}, lambda w: {map_sql(known)}[w]), lambda k: k IS NOT NULL)[1]"
KINDS = {w: k for k, ws in (("approx", Q.APPROXIMATE), ("exact", Q.EXACT), ("bound", Q.BOUND)) for w in ws}
SENT = ["about", "exactly", "more", "total", "increase", "million", "usd", "euro", "percent", "x", "y"]
worded = lambda s, d: table(s, d, "orders").select(
    "o_orderkey",
    F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.element_at(F.array(*map(F.lit, SENT)), ((F.col("o_orderkey") * i + F.col("o_custkey")) % 11 + 1).cast("int"))).alias("before"),
    F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.element_at(F.array(*map(F.lit, SENT)), ((F.col("o_custkey") * i + F.col("o_orderkey")) % 11 + 1).cast("int"))).alias("after"),
)
SENTS = "[" + ", ".join(f"'{w}'" for w in SENT) + "]"
WORDED = f"(SELECT o_orderkey, list_transform(range(1, 7), lambda i: {SENTS}[(o_orderkey * i + o_custkey) % 11 + 1]) AS before, list_transform(range(1, 7), lambda i: {SENTS}[(o_custkey * i + o_orderkey) % 11 + 1]) AS after FROM orders)"
add(
    "ctx_07_modifier",
    lambda s, d: worded(s, d).select("o_orderkey", Q.modifier(Q.frame("before", "after")).alias("modifier"), Q.aggregate_named(Q.frame("before", "after")).alias("func")),
    f"SELECT o_orderkey, {FIRST(KINDS)} AS modifier, {FIRST(Q.AGGREGATES)} AS func FROM {WORDED}",
)
NEAR = "list_filter(list_transform({}, lambda w: {}[w]), lambda k: k IS NOT NULL)"
add(
    "ctx_08_neighbour_unit",
    lambda s, d: worded(s, d).select("o_orderkey", Q.neighbour_scale_unit("before", "after")["unit"].alias("unit")),
    f"SELECT o_orderkey, coalesce({NEAR.format('after[1:5]', map_sql(Q.UNITS))}[1], {NEAR.format('list_reverse(before[2:6])', map_sql(Q.UNITS))}[1]) AS unit FROM {WORDED}",
)
add(
    "map_02_lookup_maps",
    lambda s, d: worded(s, d).select("o_orderkey", F.try_element_at(F.create_map(*[F.lit(x) for kv in Q.SCALES.items() for x in kv]), F.element_at("before", 1)).alias("scale")),
    f"SELECT o_orderkey, {map_sql(Q.SCALES)}[before[1]] AS scale FROM {WORDED}",
)
# Blocks, sentences, references.
BLOCKS = r"list_transform(string_split_regex(text, '[.;]\s*\n|\n{2,}'), lambda b: trim(regexp_replace(b, '[ \t]{2,}', ' ', 'g')))"
ADMIT = r"length(b) BETWEEN 100 AND 1000 AND length(b) - length(replace(b, chr(10), '')) <= 4 AND regexp_matches(b, '[0-9%$.,\-]')"
blocks_of = lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(T.blocks("text")).alias("block_no", "block"))
BLOCK_ROWS = f"(SELECT doc_id, CAST(unnest(range(0, len(bs))) AS INT) AS block_no, unnest(bs) AS b FROM (SELECT doc_id, {BLOCKS} AS bs FROM documents))"
add("prj_06_blocks", lambda s, d: blocks_of(s, d).where(T.block_admitted(F.col("block"))), f"SELECT doc_id, block_no, b AS block FROM {BLOCK_ROWS} WHERE {ADMIT}")
add("flt_05_block_admission", lambda s, d: blocks_of(s, d).select("doc_id", "block_no", T.block_admitted(F.col("block")).alias("ok")), f"SELECT doc_id, block_no, {ADMIT} AS ok FROM {BLOCK_ROWS}")
listing("prj_07_table_references", lambda c: T.table_references(F.concat(F.col(c), F.lit(" see Table 1.2 and table 3"))), r"regexp_extract_all(text || ' see Table 1.2 and table 3', '[tT]able\.? ?\d+(?:\.\d+)*', 0)")
listing("prj_11_single_pattern_mentions", lambda c: F.filter(F.regexp_extract_all(F.col(c), F.lit(r"\d+(?:[.,]\d+)*%?"), F.lit(0)), lambda x: ~F.rlike(x, F.lit(r"^(?:19|20)\d\d$"))), r"list_filter(regexp_extract_all(text, '\d+(?:[.,]\d+)*%?', 0), lambda x: NOT regexp_full_match(x, '(?:19|20)\d\d'))")
listing("dtm_01_ip_and_phone_patterns", lambda c: F.regexp_extract_all(F.col(c), F.lit(r"\d{1,3}(?:\.\d{1,3}){3}|\(\d{3}\) \d{3}-\d{4}"), F.lit(0)), r"regexp_extract_all(text, '\d{1,3}(?:\.\d{1,3}){3}|\(\d{3}\) \d{3}-\d{4}', 0)")
#: Each place of a text, and whether a sentence begins there.
BREAKS = r"""
WITH t AS (SELECT item_id, text, unnest(range(0, greatest(length(text), 1))) AS p FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT item_id, text, CAST(p AS INT) AS pos, CAST(p >= 2 AND regexp_matches(substr(text, p - 1, 3), '^[.!?][\x20\x09-\x0D][^\x20\x09-\x0D]') AS INT) AS br FROM t)
"""
add(
    "prj_12_sentences",
    lambda s, d: table(s, d, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "span")).select("item_id", "n", "span.start", "span.stop"),
    BREAKS + 'SELECT item_id, CAST(row_number() OVER w - 1 AS INT) AS n, pos AS "start", CAST(coalesce(lead(pos) OVER w, length(text)) AS INT) AS "stop" FROM b WHERE pos = 0 OR br = 1 WINDOW w AS (PARTITION BY item_id ORDER BY pos)',
)


def sentence_of(s, d) -> DataFrame:
    """Assigns the offsets of a text to its sentences: an interval join within the document."""
    spans = QUERIES["prj_12_sentences"](s, d)
    points = table(s, d, "benchmark").select("item_id", F.explode(F.expr("sequence(0, greatest(length(text) - 1, 0))")).alias("at"))
    return points.join(spans, "item_id").where("at >= start and at < stop").select("item_id", "at", "n")


add("prj_15_sentence_assignment", sentence_of, BREAKS + 'SELECT item_id, pos AS "at", CAST(sum(br) OVER (PARTITION BY item_id ORDER BY pos) AS INT) AS n FROM b WHERE pos < length(text)')
listing("flt_14_stop_word_filter", lambda c: T.drop_stop_words(T.tokens(c)), f"list_filter({TOKENS}, lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))", "benchmark", "item_id")
add(
    "str_21_tsv_line",
    lambda s, d: I.priors(s, d).select(F.concat_ws("\t", F.col("mx").cast("string"), F.col("mt").cast("string"), "func").alias("line")),
    with_("priors") + "SELECT concat_ws(chr(9), CAST(mx AS VARCHAR), CAST(mt AS VARCHAR), func) AS line FROM priors",
)
add(
    "str_20_number_words",
    lambda s, d: table(s, d, "part").select("p_partkey", F.try_element_at(F.create_map(*[F.lit(x) for kv in {str(i + 1): w for i, w in enumerate("one two three four five six seven eight nine ten".split())}.items() for x in kv]), F.col("p_size").cast("string")).alias("word")),
    "SELECT p_partkey, ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'][p_size] AS word FROM part",
)
