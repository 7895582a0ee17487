"""Whole pipelines on pages whose right alignments are known."""

import os

import pytest

from cellweave.operators import recognise
from cellweave.plans import align, catalog_more

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_reported_figures_find_their_cells(spark):
    pages = catalog_more.storied_pages(spark, SF)
    got = align.align_pages(pages).collect()
    texts = {r.page_id: r.html for r in pages.collect()}
    assert len(got) == 15 and all(r.score >= 0.5 for r in got)
    from cellweave.operators import html

    for r in got:
        page = html.parse(texts[int(r.doc.split(":")[0])])
        cells = {f"t.1.{i}": t for _, _, i, _, t in page["tables"][0]["cells"]}
        said = [s for _, _, s in recognise.mentions(page["content"])]
        assert cells[r.cell] == said[int(r.mention[1:]) - 1]


def test_annotation_set(spark):
    pages = catalog_more.storied_pages(spark, SF)
    journal = pages.where("page_id = 0").select("url")
    out = align.annotation_set(pages, journal)
    assert {k: v.count() for k, v in out.items()} == {"document": 4, "table": 4, "mention": 12, "mention_table": 12}
