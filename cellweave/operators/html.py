"""Pages to titles, text and tables; tables to rectangular grids. One parse a page, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import quantity as Q
from cellweave.functions import text as T

MIN_ROWS, MAX_ROWS, MIN_COLS, MAX_COLS, MIN_SHARE = 2, 100, 2, 50, 0.3
BREAKS = frozenset("p div br li h1 h2 h3 h4 h5 h6 section article header footer ul ol blockquote pre hr".split())


#: The most that a span may be, as HTML has it (fixed values).
SPANS = (("rowspan", 65534), ("colspan", 1000))


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[bool, int, int, str]]] = []
        self.caption, self.footer, self.nested = [], [], False
        self.cell: list | None = None
        self.where = ""


class PageParser(HTMLParser):
    """Title, text outside tables, scripts and styles, and the tables that hold no table, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text = [], []
        self.tables: list[_Table] = []
        self.open: list[_Table] = []
        self.skip = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "table":
            if self.open:
                self.open[-1].nested = True
            self.open.append(_Table())
            self.tables.append(self.open[-1])
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                t.rows.append([])
                t.cell = None
            elif tag in ("td", "th"):
                a = dict(attrs)
                span = [min(int(v), most) if (v := a.get(k) or "1").isdecimal() and int(v) > 0 else 1 for k, most in SPANS]
                if not t.rows:
                    t.rows.append([])
                t.cell = [tag == "th", *span, []]
                t.rows[-1].append(t.cell)
            elif tag in ("caption", "tfoot"):
                t.where = tag
            elif tag == "br" and t.cell:
                t.cell[3].append(" ")
        elif tag in BREAKS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "table" and self.open:
            self.open.pop()
        elif self.open and tag in ("td", "th"):
            self.open[-1].cell = None
        elif self.open and tag in ("caption", "tfoot"):
            self.open[-1].where = ""
        elif not self.open and tag in BREAKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title.append(data)
        elif self.open:
            t = self.open[-1]
            if t.where == "caption":
                t.caption.append(data)
            elif t.where == "tfoot":
                t.footer.append(data)
            if t.cell:
                t.cell[3].append(data)
        else:
            self.text.append(data)


def squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split()).lower()


def positions(rows) -> list[tuple[int, int, int, bool, str]]:
    """(r, c, cell_id, is_header, text) of every slot; spans repeat their cell's id, data cells count 1, 2, ..., headers -1, -2, ..."""
    taken: set[tuple[int, int]] = set()
    out, data, head = [], 0, 0
    for r, row in enumerate(rows):
        c = 0
        for is_head, down, across, parts in row:
            while (r, c) in taken:
                c += 1
            data, head = (data, head - 1) if is_head else (data + 1, head)
            cell = head if is_head else data
            text = squeeze(parts)
            for i in range(r, min(r + down, len(rows))):
                for j in range(c, c + across):
                    if (i, j) not in taken:
                        taken.add((i, j))
                        out.append((i, j, cell, is_head, text))
            c += across
    return sorted(out)


def parse(html: str | None) -> dict:
    """title, content and tables; a page that cannot be parsed is empty."""
    p = PageParser()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):
        return {"title": "", "content": "", "tables": []}
    tables = []
    for t in p.tables:
        if not t.nested:
            tables.append({"table_id": len(tables) + 1, "caption": squeeze(t.caption), "footer": squeeze(t.footer), "cells": positions(t.rows)})
    return {"title": " ".join("".join(p.title).split()), "content": "".join(p.text).strip(), "tables": tables}


_CELL = pa.struct([("r", pa.int32()), ("c", pa.int32()), ("cell_id", pa.int32()), ("is_header", pa.bool_()), ("text", pa.string())])
_TABLE = pa.struct([("table_id", pa.int32()), ("caption", pa.string()), ("footer", pa.string()), ("cells", pa.list_(_CELL))])
TABLES = "array<struct<table_id:int,caption:string,footer:string,cells:array<struct<r:int,c:int,cell_id:int,is_header:boolean,text:string>>>>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, title, content, tables."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [parse(h) for h in b.column(1).to_pylist()]
            for o in out:
                for t in o["tables"]:
                    t["cells"] = [dict(zip(("r", "c", "cell_id", "is_header", "text"), x)) for x in t["cells"]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([o["title"] for o in out], pa.string()), pa.array([o["content"] for o in out], pa.string()), pa.array([o["tables"] for o in out], pa.list_(_TABLE))],
                names=["page_id", "title", "content", "tables"],
            )

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, title string, content string, tables {TABLES}")


def grid_cells(pages: DataFrame) -> DataFrame:
    """page_id, table_id, r, c, cell_id, is_header, text of every slot of every table."""
    t = parsed(pages).select("page_id", F.explode("tables").alias("t"))
    return t.select("page_id", "t.table_id", F.explode("t.cells").alias("x")).select("page_id", "table_id", "x.*")


def table_sizes(cells: DataFrame) -> DataFrame:
    """n_rows, n_cols, n_filled, n_quantity and admitted of every table."""
    df = cells.groupBy("page_id", "table_id").agg(
        (F.max("r") + 1).alias("n_rows"),
        (F.max("c") + 1).alias("n_cols"),
        F.countDistinct(F.when(F.col("text") != "", F.col("cell_id"))).alias("n_filled"),
        F.countDistinct(F.when(Q.is_quantity("text"), F.col("cell_id"))).alias("n_quantity"),
    )
    ok = F.col("n_rows").between(MIN_ROWS, MAX_ROWS) & F.col("n_cols").between(MIN_COLS, MAX_COLS)
    return df.withColumn("admitted", ok & (F.coalesce(F.try_divide("n_quantity", "n_filled"), F.lit(0.0)) >= MIN_SHARE))


def cell_mentions(cells: DataFrame) -> DataFrame:
    """Quantity cells with value, sign, precision, scale and unit; a year in the first row is none."""
    first = F.row_number().over(Window.partitionBy("page_id", "table_id", "cell_id").orderBy("r", "c"))
    q = cells.withColumn("n", first).where((F.col("n") == 1) & Q.is_quantity("text") & ~((F.col("r") == 0) & Q.is_year("text")))
    v = Q.value("text")
    return q.select(
        "page_id", "table_id", "r", "c", "cell_id", "text",
        F.when(Q.negative("text"), -v).otherwise(v).alias("v"),
        Q.precision("text").alias("prec"), Q.scale_of("text").alias("own_scale"), Q.unit_of("text").alias("own_unit"),
    )


def line_metadata(cells: DataFrame) -> DataFrame:
    """axis, line, scale, unit: what headers in the first row and column say of their columns and rows."""
    top = cells.where((F.col("r") == 0) & ~Q.is_quantity("text")).select("page_id", "table_id", F.lit("col").alias("axis"), F.col("c").alias("line"), "text")
    left = cells.where((F.col("c") == 0) & ~Q.is_quantity("text")).select("page_id", "table_id", F.lit("row").alias("axis"), F.col("r").alias("line"), "text")
    return top.unionByName(left).withColumns({"scale": Q.scale_of("text"), "unit": Q.unit_of("text")})


def with_context(mentions: DataFrame, cells: DataFrame) -> DataFrame:
    """Scale and unit of each quantity: its own, else its column's, else its row's, else the table's first."""
    meta = line_metadata(cells)
    by = lambda axis, line, p: meta.where(F.col("axis") == axis).groupBy("page_id", "table_id", "line").agg(F.max(F.when(F.col("scale") != 1, F.col("scale"))).alias(f"{p}_scale"), F.max("unit").alias(f"{p}_unit")).withColumnRenamed("line", line)
    whole = meta.groupBy("page_id", "table_id").agg(
        F.min_by("scale", F.when(F.col("scale") != 1, F.struct("axis", "line"))).alias("t_scale"), F.min_by("unit", F.when(F.col("unit").isNotNull(), F.struct("axis", "line"))).alias("t_unit")
    )
    df = mentions.join(by("col", "c", "c"), ["page_id", "table_id", "c"], "left").join(by("row", "r", "r"), ["page_id", "table_id", "r"], "left").join(whole, ["page_id", "table_id"], "left")
    own = F.when(F.col("own_scale") != 1, F.col("own_scale"))
    return df.withColumns(
        {"scale": F.coalesce(own, "c_scale", "r_scale", "t_scale", F.lit(1.0)), "unit": F.coalesce("own_unit", "c_unit", "r_unit", "t_unit")}
    ).drop("c_scale", "r_scale", "t_scale", "c_unit", "r_unit", "t_unit")


def context_words(cells: DataFrame) -> DataFrame:
    """axis, line, words: distinct content words of each row's and column's cells that are no quantity."""
    words = cells.where(~Q.is_quantity("text")).withColumn("word", F.explode(T.content_tokens("text")))
    rows = words.groupBy("page_id", "table_id", F.lit("row").alias("axis"), F.col("r").alias("line")).agg(F.array_sort(F.collect_set("word")).alias("words"))
    cols = words.groupBy("page_id", "table_id", F.lit("col").alias("axis"), F.col("c").alias("line")).agg(F.array_sort(F.collect_set("word")).alias("words"))
    return rows.unionByName(cols)
