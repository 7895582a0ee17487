"""Operators beyond SQL: recogniser, pages, stems, walks, resolution, sources and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave import sources, streaming
from cellweave.functions import similarity, text
from cellweave.operators import graph, html, recognise, virtual


@pytest.mark.parametrize(
    "s,want",
    [
        ("Revenue was $3.5 million in 2014", ["$3.5 million"]),
        ("On March 3, 2014 it rose 5% to 1,200 units", ["5%", "1,200"]),
        ("from $1,200 to $1,300 million", ["$1,200 to $1,300 million"]),
        ("about 12-13% and 100 km per hour", ["100 km per hour", "12-13%"]),
        ("see table 2.1 and section 3, 45 minutes", []),
        ("ring +31 20 555 7788 at 9:45 pm [12]", []),
        ("Sales of 14 Feb 2011, 3/4/2012 and 2013-07; sec. 3.1 to 3.4", []),
        ("a 20\u201325% gain, \u20ac40 to \u20ac45 bn, 60 \u00b1 5 mg per day, 1.5 m/s", ["60 \u00b1 5 mg per day", "1.5 m/s", "20\u201325%", "\u20ac40 to \u20ac45 bn"]),
        ("x86 and 4th of 1.2.3 on page 7. then 12 percent of 30 thousand", ["12 percent", "30 thousand"]),
        ("won 2:1 with 17 goals", ["2:1", "17"]),
        ("", []),
        (None, []),
    ],
)
def test_recogniser(s, want):
    assert [x for _, _, x in recognise.mentions(s)] == want


def test_recogniser_offsets_and_mask():
    s = "a\xa0value of €12.5k, 30 per cent and 7 m per s on 12/11/2013"
    for start, stop, surface in recognise.mentions(s):
        assert s.replace("\xa0", " ")[start:stop].strip() == surface


def test_recogniser_on_plain_numbers_matches_brute_force():
    """Texts of words and numbers alone: every number of two digits or more, once, in order."""
    import random

    rnd = random.Random(4)
    for _ in range(200):
        parts = [rnd.choice(["sold", "cars", "were", "x7", "7x", str(rnd.randrange(10)), str(rnd.randrange(10, 99)), f"{rnd.randrange(1, 99)},{rnd.randrange(100, 999)}"]) for _ in range(12)]
        text = " | ".join(parts)
        want = [x for x in parts if x.replace(",", "").isdecimal() and len(x) > 1]
        assert [x for _, _, x in recognise.mentions(text)] == want


SPANS = "<table><tr><th>h<td rowspan=2>a<br>b<td colspan='2'>c<tr><td>d<td>e<td>f</table>"


def test_grid_with_spans():
    cells = html.parse(SPANS)["tables"][0]["cells"]
    assert [(r, c, i, t) for r, c, i, _, t in cells] == [
        (0, 0, -1, "h"), (0, 1, 1, "a b"), (0, 2, 2, "c"), (0, 3, 2, "c"), (1, 0, 3, "d"), (1, 1, 1, "a b"), (1, 2, 4, "e"), (1, 3, 5, "f"),
    ]


def test_nested_tables_and_bad_pages():
    p = html.parse("<title> T\n x</title><table><tr><td><table><caption>In</caption><tr><td>1<td>2</table></table><script>s</script>z")
    assert (p["title"], p["content"], len(p["tables"]), p["tables"][0]["caption"]) == ("T x", "z", 1, "in")
    assert html.parse(None) == {"title": "", "content": "", "tables": []}
    assert html.parse("<table><tr><td colspan=\u00b2>1</table>z")["content"] == "z"
    assert len(html.parse("<table><tr><td colspan=4000000>1<td>2</table>")["tables"][0]["cells"]) == 1001
    assert html.parse("<table><tr><td rowspan=x>1")["tables"][0]["cells"] == [(0, 0, 1, False, "1")]


def test_context_of_cells(spark):
    page = "<table><tr><th>item<th>sales ($ million)<th>share %<tr><td>north<td>5<td>10<tr><td>south<td>7<td>20</table>"
    cells = html.grid_cells(spark.createDataFrame([(1, page)], "page_id long, html string"))
    got = {r.cell_id: (r.v, r.scale, r.unit) for r in html.with_context(html.cell_mentions(cells), cells).collect()}
    assert got == {2: (5.0, 1e6, "$"), 3: (10.0, 1e6, "%"), 5: (7.0, 1e6, "$"), 6: (20.0, 1e6, "%")}
    assert html.table_sizes(cells).first().admitted


@pytest.mark.parametrize(
    "word,want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("relational", "relat"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"),
    ],
)
def test_stem(word, want):
    assert text.porter(word) == want


def test_jaro():
    assert abs(similarity.jaro_of("martha", "marhta") - 0.944444) < 1e-6
    assert abs(similarity.jaro_of("dixon", "dicksonx") - 0.766667) < 1e-6
    assert similarity.jaro_of("", "") == 0 and similarity.jaro_of("a", "a") == 1 and similarity.jaro_of("a", None) is None
    assert similarity.jaro_of("abc", "cab") == similarity.jaro_of("cab", "abc")


def test_virtual_cells(spark):
    rows = [(1, 1, 1, 1, 10.0, "$"), (1, 1, 2, 2, -4.0, "$"), (1, 1, 3, 3, 5.0, None)]
    cells = spark.createDataFrame(rows, "table_id int, r int, c int, cell_id int, v double, unit string")
    got = {(r.key, r.func): (r.value, r.inverse) for r in virtual.virtual_cells(cells).collect()}
    assert got[("1,2,3", "sum")] == (6.0, None) and got[("1,2,3", "avg")] == (2.0, None)
    assert got[("1,2", "dif")] == (14.0, -14.0) and got[("1,2", "percentage")] == (250.0, -40.0) and got[("1,2", "rat")] == (350.0, 140.0)
    assert ("1,3", "dif") not in got


def test_pagerank():
    w = np.array([[0, 1.0, 0], [0.5, 0, 0.5], [0, 0, 0]])
    x = graph.pagerank(w, 0, 1000, 1e-12)
    assert abs(x.sum() - 1) < 1e-9 and x[0] > x[2] > 0


def test_resolution_uses_earlier_decisions():
    edges = pd.DataFrame([("m1", "m2", 0.9), ("m2", "m1", 0.9), ("t.1", "t.2", 0.9), ("t.2", "t.1", 0.9)], columns=["src", "dst", "w"])
    priors = pd.DataFrame([("m1", "t.1", 0.9), ("m2", "t.2", 0.5), ("m2", "t.9", 0.5)], columns=["src", "dst", "prob"])
    out = graph.resolve_document(edges, priors)
    assert out["cell"].tolist() == ["t.1", "t.2"] and out["mention"].tolist() == ["m1", "m2"]


def test_resolution_of_documents(spark):
    edges = spark.createDataFrame([(1, "m1", "m2", 0.5)], "doc int, src string, dst string, w double")
    priors = spark.createDataFrame([(1, "m1", "t.1", 0.8), (2, "m1", "t.1", 0.2), (2, "m1", "t.2", 0.1)], "doc int, src string, dst string, prob double")
    got = {(r.doc, r.cell) for r in graph.resolve(edges, priors).collect()}
    assert got == {(1, "t.1"), (2, None)}


def test_malformed_json_is_dropped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"docID": "1", "url": "u", "fullText": "x"}\nnot json\n')
    assert [r.docID for r in sources.json_lines(spark, str(tmp_path)).collect()] == ["1"]


def test_settings(tmp_path):
    (tmp_path / "x.ini").write_text("[db]\nhost = h\n")
    assert sources.settings(str(tmp_path / "x.ini"), "db") == {"host": "h"}
    with pytest.raises(KeyError):
        sources.settings(str(tmp_path / "x.ini"), "none")


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(200).select((F.col("id") % 3).cast("string").alias("name"), F.col("id").alias("value"))
    rows.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming.running_counters(stream).writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "marks")).start().awaitTermination()
    got = {tuple(r) for r in spark.table("counters").collect()}
    assert got == {tuple(r) for r in rows.groupBy("name").agg(F.sum("value")).collect()}


def test_stream_windows_and_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 10).alias("k"))
    rows.coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(rows.schema).parquet(src)
    for name, df in (("seen", streaming.once(read(), "k", "ts", "30 days")), ("wins", streaming.windowed_counts(read(), "ts", "k"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True)
        q.option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert spark.table("seen").count() == 10
    assert spark.table("wins").count() > 0


def test_keyed_lines_keep_every_field(spark, tmp_path):
    from cellweave import sources

    (tmp_path / "wide.tsv").write_text("a k " + " ".join(map(str, range(1500))) + "\nb k\nalone\n")
    got = {r.key: r.fields for r in sources.keyed_lines(spark, str(tmp_path), 0).collect()}
    assert got == {"a": ["k", *map(str, range(1500))], "b": ["k"]}
    assert sorted(len(r.fields) for r in sources.keyed_lines(spark, str(tmp_path), 1).collect()) == [0, 1500]
