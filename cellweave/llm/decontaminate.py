"""Benchmark decontamination by a positional inverted index. DataFrame and SQL functions only.

The index holds postings (term, document, position) of the training texts. A benchmark window is
looked up by its ``RAREST`` terms, those with the fewest postings in the corpus: the rarest term's
list, each position less the term's offset in the window, is a list of possible starts; the next
rarest terms' lists, offset-adjusted alike, are intersected with it by equi-joins on (document,
position). What is left is checked against the text. Only terms that some window has among its
rarest are stored, since no other list is ever read.

Sides are broadcast behind a count of their rows (``MAX_BROADCAST``); beyond it the same joins
shuffle. Postings are joined by document and position; only with more than ``MAX_BROADCAST`` terms in
the benchmark are words joined by term, where both sides are written tables or plain scans and a
frequent term is split by adaptive execution.

Defined cases: null or wordless texts have no words and no hits; wordless items have no windows;
items with equal ids are one item; an item with a null id counts towards hits but is not listed;
equal document rows get equal results; ids may be integers or text; texts of any length are indexed
whole; other columns, of any name, are ignored or passed on; empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import guarded, keep_rows, table, terms, text_hash, written

WINDOW = 10
RAREST = 3
#: Rows of a side that may be broadcast: terms and windows of about 100 bytes, so 50 MB at most.
MAX_BROADCAST = 500_000
#: Occurrences of candidate windows, of about 50 bytes, that may be broadcast with their documents.
MAX_CANDIDATES = 500_000


def _key(words: Column) -> list[Column]:
    """128 bits that name a window."""
    return [F.xxhash64(words).alias("k1"), F.xxhash64(F.lit(1), words).alias("k2")]


def windows(items: DataFrame) -> DataFrame:
    """(k1, k2, words, items): the different windows of the items and the ids that have each."""
    rows = items.select("item_id", terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.select(
        "item_id",
        F.explode(
            F.expr(f"transform(sequence(1, greatest(size(w) - {WINDOW - 1}, 1)), i -> slice(w, i, {WINDOW}))")
        ).alias("words"),
    )
    return rows.groupBy("words").agg(F.collect_set("item_id").alias("items")).select(*_key(F.col("words")), "words", "items")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, term) of every document word."""
    return docs.select("doc_id", text_hash().alias("th"), F.posexplode(terms(F.col("text"))).alias("pos", "term"))


class Index:
    """Postings of the corpus for the rarest terms of a set of windows."""

    def __init__(self, docs: DataFrame, wins: DataFrame):
        self.docs = docs
        self.wins = written(wins, "windows")
        vocabulary = self.wins.select(F.explode("words").alias("term")).distinct()
        vocabulary = written(vocabulary, "vocabulary")
        side = guarded(vocabulary, vocabulary.count(), MAX_BROADCAST)
        counts = written(tokens(docs).select("term").join(side, "term").groupBy("term").agg(F.count("*").alias("df")), "counts")
        # The rarest terms of each window; a window with a term that no text has is gone already.
        parts = self.wins.select("k1", "k2", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
        parts = parts.join(guarded(counts, counts.count(), MAX_BROADCAST), "term")
        by_window = Window.partitionBy("k1", "k2")
        ranked = parts.withColumns(
            {"rank": F.row_number().over(by_window.orderBy("df", "off")), "found": F.count("*").over(by_window)}
        ).where("found = n")
        self.anchors = written(
            ranked.where(F.col("rank") <= RAREST).select("k1", "k2", "n", "rank", "off", "term"), "anchors"
        )
        wanted = written(self.anchors.select("term").distinct(), "terms")
        self.postings = written(tokens(docs).join(guarded(wanted, wanted.count(), MAX_BROADCAST), "term"), "postings")

    def _anchor(self, rank: int) -> DataFrame:
        return self.anchors.where(F.col("rank") == rank).select(
            "k1", "k2", "n", F.col("off").alias("o"), F.col("term").alias("t")
        )

    def candidates(self) -> DataFrame:
        """(doc_id, th, start, n, k1, k2) where a window's rarest terms all stand at their offsets."""
        first = self._anchor(1)
        found = (
            self.postings.join(guarded(first, first.count(), MAX_BROADCAST), F.col("term") == F.col("t"))
            .select("doc_id", "th", (F.col("pos") - F.col("o")).alias("start"), "n", "k1", "k2")
            .where("start >= 0")
        )
        for rank in range(2, RAREST + 1):
            nxt = self._anchor(rank)
            # Windows of fewer words have no such rank and pass as they are.
            found = found.join(guarded(nxt.drop("n"), nxt.count(), MAX_BROADCAST), ["k1", "k2"], "left").withColumn(
                "at", F.col("start") + F.col("o")
            )
            p = self.postings.select(
                F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("pos").alias("p"), F.col("term").alias("q")
            )
            same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("at") == F.col("p")) & (F.col("t") == F.col("q"))
            keep = ["doc_id", "th", "start", "n", "k1", "k2"]
            found = (
                found.where("t is not null").join(p, same, "left_semi").select(*keep).unionByName(found.where("t is null").select(*keep))
            )
        return found

    def phrases(self) -> DataFrame:
        """One row per document row: doc_id, th, n_words, hits (start, n, k1, k2 of each window's occurrences)."""
        found = self.candidates().groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n", "k1", "k2")).alias("c"))
        found = written(found.withColumnsRenamed({"doc_id": "d", "th": "h"}), "candidates")
        size = found.agg(F.coalesce(F.sum(F.size("c")), F.lit(0))).first()[0]
        rows = self.docs.select("doc_id", text_hash().alias("th"), terms(F.col("text")).alias("w")).join(
            guarded(found, size, MAX_CANDIDATES), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left"
        )
        true = F.expr(
            "filter(c, x -> xxhash64(slice(w, x.start + 1, x.n)) = x.k1 and xxhash64(1, slice(w, x.start + 1, x.n)) = x.k2)"
        )
        return rows.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.array_sort(true).alias("hits"))

    def proximity(self, slop: int) -> DataFrame:
        """(doc_id, th, k1, k2): documents where a window's rarest terms stand within ``slop`` words of its rarest."""
        near = lambda: self.postings.select("doc_id", "th", F.col("pos").alias("p"), F.col("term").alias("t"))
        found = near().join(self._anchor(1).drop("o"), "t").select(
            "doc_id", "th", F.col("p").alias("at"), "k1", "k2", F.floor(F.col("p") / slop).alias("cell")
        )
        for rank in range(2, RAREST + 1):
            nxt = self._anchor(rank).select("k1", "k2", F.col("t").alias("t2"))
            found = found.join(nxt, ["k1", "k2"], "left")
            p = near().withColumn("c", F.explode(F.expr(f"transform(array(-1, 0, 1), x -> floor(p / {slop}) + x)")))
            p = p.withColumnsRenamed({"doc_id": "d", "th": "h"})
            close = (
                F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("t") == F.col("t2"))
                & (F.col("cell") == F.col("c")) & (F.abs(F.col("p") - F.col("at")) <= slop)
            )
            keep = ["doc_id", "th", "at", "k1", "k2", "cell"]
            found = found.where("t2 is not null").join(p, close, "left_semi").select(*keep).unionByName(found.where("t2 is null").select(*keep))
        return found.select("doc_id", "th", "k1", "k2").distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, th and the contract's columns, a row for each document row."""
    index = Index(docs, windows(items))
    marks = written(index.phrases(), "marks")
    covered = F.expr(
        """aggregate(hits, struct(0L as n, 0L as upto), (a, x) -> struct(
             a.n + greatest(0L, x.start + x.n - greatest(cast(x.start as bigint), a.upto)) as n,
             greatest(a.upto, cast(x.start + x.n as bigint)) as upto)).n"""
    )
    hit = marks.where(F.size("hits") > 0)
    which = hit.select("doc_id", "th", F.explode("hits").alias("x")).select("doc_id", "th", "x.k1", "x.k2").distinct()
    ids = index.wins.select("k1", "k2", F.explode(F.col("items").cast("array<string>")).alias("item"))
    listed = which.join(ids, ["k1", "k2"]).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    listed = listed.withColumnsRenamed({"doc_id": "d", "th": "h"})
    out = marks.join(listed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    return out.select(
        "doc_id",
        "th",
        "n_words",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
    ).withColumns({"n_items": F.greatest("n_items", F.lit(0).cast("long")), "contaminated": F.col("n_hit") > 0})


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


#: The same rows by plain enumeration of all windows of all texts.
OP2_SQL = r"""
WITH dt AS (
  SELECT rowid_ AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
it AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM it WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dt, ns WHERE len(w) >= n)),
hit AS (SELECT r, s, dw.n, item_id FROM dw JOIN iw USING (n, k)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dt LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window, columns unchanged."""
    bad = written(contamination(docs, items).where("contaminated").select("doc_id", "th").distinct(), "contaminated")
    return keep_rows(docs, bad, "left_anti", bad.count(), MAX_BROADCAST)
