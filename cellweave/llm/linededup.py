"""Line dedup by a fixed-depth template tree. DataFrame and SQL functions only.

Records: a line is cut after each sentence of ``LONG`` tokens or more (a sentence ends with a token
in ``.``, ``!`` or ``?``, or with the line), so shorter sentences go with what follows them. A
record's cuts depend on its own sentences only: a passage repeated inside longer lines gives the same
records there.

Tree: a record's path is its token count, then the tokens that its leaf keeps; tokens that hold a
digit are masked as ``<*>``. The classic path keeps the leading tokens; here each record goes down
several paths, one for each part of it that may vary, so a leaf's template has wildcards wherever its
records differ outside the kept tokens, and variable leading tokens are met by a path that starts
later. A template keeps ``LONG`` tokens at least:

- ``HALVES`` tokens or more: the first half, the last half, the middle half, or the outer quarters
  are kept; one or several variable fields may be anywhere in the rest (so one early and one late).
- ``THIRDS`` to ``HALVES`` tokens: two thirds are kept, any one third may vary.
- fewer tokens: all are kept.

A template recurs if it occurs under ``MIN_DOCS_LONG`` different doc_ids or more
(``MIN_DOCS_SHORT`` for records of under ``LONG`` tokens, which meet by chance). Its records stay
where the template is first seen, under its smallest doc_id, and are dropped everywhere else; so of a
group of copies one keeps its text. A line whose words are all dropped goes whole.

Records become rows of a 64-bit path hash beside the token count, never rows of text, and are counted
with partial aggregation (at 10**13 paths, about one record in 10**8 would meet a foreign path). Each
document's dropped records then join back to its text.

Defined cases: null text stays null and has no lines; records without a word are kept; rows of one
doc_id are one document for counting (null is an id of its own, and the smallest); repeats of a
record inside its own document stay; doc_ids may be integers or text; equal rows get equal results;
extra columns of any name are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import free_names, order_id, own_columns, table, written

LONG = 10
THIRDS = 15
HALVES = 20
MIN_DOCS_LONG = 2
MIN_DOCS_SHORT = 10
WS = r"\x20\x09-\x0D"
#: A sentence of LONG tokens or more, with the white space after it. Possessive and begun at token
#: starts only, so that it is linear in the line.
SENTENCE = rf"(?<![^{WS}])((?:[^{WS}]*[^{WS}.!?][{WS}]+){{{LONG - 1},}}+(?:[^{WS}]*[.!?][{WS}]|[^{WS}]*\z))"


def row_hash():
    """32 bits that tell rows of one doc_id apart."""
    return F.hash(F.coalesce("text", F.lit("")))


def _records(line: str) -> str:
    """SQL: the records of a line; together they are the line."""
    return f"split(regexp_replace({line}, r'{SENTENCE}', '$1\\n'), '\\n')"


def record_rows(docs: DataFrame) -> DataFrame:
    """(id, th, line_no, rec_no, n, k): a row for each path of each record that has a word."""
    rows = docs.select(
        order_id(docs).alias("id"), row_hash().alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).where(F.col("line") != "")
    rows = rows.select("id", "th", "line_no", F.posexplode(F.expr(_records("line"))).alias("rec_no", "r"))
    odd = F.col("r").rlike(r"[\t-\r]|  |^ | $")
    rows = rows.withColumn("r", F.when(odd, F.trim(F.regexp_replace("r", r"[\x20\x09-\x0D]+", " "))).otherwise(F.col("r")))
    rows = rows.where(F.col("r") != "").withColumn(
        "r", F.when(F.col("r").rlike("[0-9]"), F.regexp_replace("r", r"[^ ]*[0-9][^ ]*", "<*>")).otherwise(F.col("r"))
    )
    rows = rows.withColumn("t", F.split("r", " ")).withColumn("n", F.size("t"))
    paths = F.expr(
        f"""case when n >= {HALVES} then array(
              xxhash64('first', slice(t, 1, n div 2)),
              xxhash64('last', slice(t, n div 2 + 1, n)),
              xxhash64('middle', slice(t, n div 4 + 1, 3 * n div 4 - n div 4)),
              xxhash64('outer', slice(t, 1, n div 4), slice(t, 3 * n div 4 + 1, n)))
            when n >= {THIRDS} then array(
              xxhash64('to', slice(t, 1, 2 * n div 3)),
              xxhash64('from', slice(t, n div 3 + 1, n)),
              xxhash64('around', slice(t, 1, n div 3), slice(t, 2 * n div 3 + 1, n)))
            else array(xxhash64('all', r)) end"""
    )
    return rows.select("id", "th", "line_no", "rec_no", "n", F.explode(paths).alias("k"))


def recurring(rows: DataFrame) -> DataFrame:
    """(k, n, first): the templates that recur and the doc_id that keeps them."""
    long = (
        rows.where(F.col("n") >= LONG)
        .groupBy("k", "n")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first != last")
        .select("k", "n", "first")
    )
    short = (
        rows.where(F.col("n") < LONG)
        .select("k", "n", "id")
        .distinct()
        .groupBy("k", "n")
        .agg(F.min("id").alias("first"), F.count("*").alias("docs"))
        .where(F.col("docs") >= MIN_DOCS_SHORT)
        .select("k", "n", "first")
    )
    assert MIN_DOCS_LONG == 2  # first != last says just that
    return long.unionByName(short)


def dropped_records(docs: DataFrame) -> DataFrame:
    """(id, th, dropped): for documents that lose records, their (line_no, recs) in ascending order."""
    rows = written(record_rows(docs), "records")
    # Written first, so that the join's sides are both plain exchanges and a hot template can be split.
    often = written(recurring(rows), "recurring")
    hits = rows.join(often, ["k", "n"]).where("id != first").select("id", "th", "line_no", "rec_no")
    lines = hits.repartition("id", "th").groupBy("id", "th", "line_no").agg(F.array_sort(F.collect_set("rec_no")).alias("recs"))
    return lines.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("line_no", "recs"))).alias("dropped"))


def _slices(whole: str, d: str, at: str, between: str) -> str:
    """SQL: what stands in ``whole`` between the places ``at`` of ``d`` (one slice each, so linear), with ``between`` for them."""
    place = lambda j: at.replace("#", f"get({d}, {j})")
    return (
        f"flatten(transform(sequence(0, size({d})), j -> concat(slice({whole}, coalesce({place('j - 1')} + 2, 1),"
        f" coalesce({place('j')}, size({whole})) - coalesce({place('j - 1')} + 1, 0)), {between})))"
    )


def without_recurring(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with recurring records taken out of ``text``, and the names of two columns more: what was dropped (null: nothing), the number of lines."""
    lost = dropped_records(docs)
    i, th, di, dt, d, lines, n = free_names(docs, 7)
    lost = lost.select(F.col("id").alias(di), F.col("th").alias(dt), F.col("dropped").alias(d))
    df = docs.withColumns({i: order_id(docs), th: row_hash()}).join(
        lost, (F.col(i) == F.col(di)) & (F.col(th) == F.col(dt)), "left"
    )
    df = df.withColumn(lines, F.split("text", "\n"))
    # A line's records without the dropped ones; null if no word is left.
    kept = f"array_join({_slices('g', f'get({d}, j).recs', '#', 'array()').replace('j ->', 'i ->').replace('j - 1', 'i - 1').replace(', j)', ', i)').replace(f'get({d}, i)', f'get({d}, j)')}, '')"
    line = f"transform(transform(array({_records(f'get({lines}, get({d}, j).line_no)')}), g -> {kept}), x -> if(x rlike r'[^{WS}]', x, null))"
    whole = _slices(lines, d, "#.line_no", f"if(j < size({d}), {line}, array())")
    text = F.when(F.col(d).isNull(), F.col("text")).otherwise(F.expr(f"array_join(filter({whole}, x -> x is not null), '\n')"))
    df = df.withColumn("text", text).withColumn(n, F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0)).cast("long"))
    return df.drop(i, th, di, dt, lines), d, n


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without recurring records, n_lines, n_dropped, and the dropped records as line:record numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df, d, n = without_recurring(docs)
    flat = F.expr(f"coalesce(flatten(transform({d}, x -> transform(x.recs, r -> concat(x.line_no, ':', r)))), array())")
    return df.withColumn("dropped", flat).select(
        "doc_id",
        "text",
        F.col(n).alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join("dropped", ",").alias("dropped"),
    )


#: The same rows by templates spelled out, not hashed.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(range(0, len(l))) AS k, unnest(l) AS line FROM d WHERE text IS NOT NULL),
y AS (SELECT *, string_split(regexp_replace(line,
  '((?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09-\x0D]+){9,}(?:[^\x20\x09-\x0D]*[.!?][\x20\x09-\x0D]|[^\x20\x09-\x0D]*\z))',
  '\1' || chr(10), 'g'), chr(10)) AS s FROM x),
z AS (SELECT r, doc_id, k, unnest(range(0, len(s))) AS j, unnest(s) AS seg FROM y),
m AS (SELECT r, doc_id, k, j, list_transform(list_filter(string_split_regex(seg, '[\x20\x09-\x0D]+'), lambda t: t <> ''),
  lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM z),
n AS (SELECT *, len(t) AS n, len(t) // 4 AS q1, len(t) // 2 AS q2, 3 * len(t) // 4 AS q3, len(t) // 3 AS a, 2 * len(t) // 3 AS b FROM m WHERE len(t) > 0),
p AS (
  SELECT r, doc_id, k, j, n, 'A' AS p, t AS v FROM n WHERE n < 15
  UNION ALL SELECT r, doc_id, k, j, n, 'T', t[1:b] FROM n WHERE n BETWEEN 15 AND 19
  UNION ALL SELECT r, doc_id, k, j, n, 'F', t[a + 1:n] FROM n WHERE n BETWEEN 15 AND 19
  UNION ALL SELECT r, doc_id, k, j, n, 'R', list_concat(t[1:a], t[b + 1:n]) FROM n WHERE n BETWEEN 15 AND 19
  UNION ALL SELECT r, doc_id, k, j, n, '1', t[1:q2] FROM n WHERE n >= 20
  UNION ALL SELECT r, doc_id, k, j, n, '2', t[q2 + 1:n] FROM n WHERE n >= 20
  UNION ALL SELECT r, doc_id, k, j, n, 'M', t[q1 + 1:q3] FROM n WHERE n >= 20
  UNION ALL SELECT r, doc_id, k, j, n, 'O', list_concat(t[1:q1], t[q3 + 1:n]) FROM n WHERE n >= 20),
keys AS (SELECT r, doc_id, k, j, n, p || n || ' ' || array_to_string(v, ' ') AS key FROM p),
f AS (SELECT key, min(doc_id) AS first FROM keys GROUP BY key HAVING count(DISTINCT doc_id) >= CASE WHEN max(n) >= 10 THEN 2 ELSE 10 END),
gone AS (SELECT DISTINCT r, k, j FROM keys JOIN f USING (key) WHERE doc_id <> first),
g AS (SELECT r, k, z.j, seg, gone.j IS NOT NULL AS off FROM z LEFT JOIN gone USING (r, k, j)),
lines AS (SELECT r, k, bool_or(off) AS cut, coalesce(string_agg(seg, '' ORDER BY j) FILTER (NOT off), '') AS line FROM g GROUP BY r, k),
texts AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT cut OR regexp_matches(line, '[^\x20\x09-\x0D]')), '') AS text FROM lines GROUP BY r),
a AS (SELECT r, count(*) AS c, string_agg(k || ':' || j, ',' ORDER BY k, j) AS ks FROM gone GROUP BY r)
SELECT doc_id, texts.text, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_dropped, coalesce(ks, '') AS dropped
FROM d LEFT JOIN texts USING (r) LEFT JOIN a USING (r)
"""


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with shorter texts, all rows and columns kept; n_chars, where present, follows the text."""
    out, d, _ = without_recurring(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(d).isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*own_columns(docs))
