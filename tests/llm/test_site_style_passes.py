import pytest
from pyspark.sql import functions as F

from gleanspark.llm.shared import utf8
from gleanspark.llm.site_style import MIN_PAGES, _counted, _trees, importance, main_texts
from tests.llm.test_site_style import site
from tests.llm.test_site_style_articles import OFFER, own


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").repartition(3)


def test_html_is_read_for_nodes_and_for_text_alone(spark):
    rows, read = site("a.example", 9) + [own(i, OFFER) for i in range(9)], spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    pages = table(spark, rows)
    got = main_texts(pages.mapInArrow(counted, pages.schema)).collect()
    assert len(got) == len(rows)
    assert not any("Follow us" in r.text or "Offer" in r.text for r in got)
    assert read.value == 2 * len(rows)


def prepared(spark, rows):
    pages = table(spark, rows).select(F.lit("a.example").alias("host"), utf8(F.col("html")).alias("body"))
    return pages.withColumns({"k1": F.xxhash64("body"), "k2": F.xxhash64("body", F.lit(2))}).coalesce(1)


def test_pages_of_one_shape_hand_on_their_nodes_once(spark):
    rows = _trees(prepared(spark, site("a.example", 9) + [("", None)] * 2)).collect()
    shapes = {(r.s1, r.s2): r.n for r in rows if r.nodes is not None}
    pages = [r for r in rows if r.nodes is None]
    assert len(rows) - len(pages) == len(shapes) == 4  # one to three more paragraphs, and no page
    assert sorted(shapes.values()) == [2, 3, 3, 3]
    assert {(r.s1, r.s2) for r in pages} == set(shapes) and len(pages) == 11
    root = next(r for r in rows if r.n == 2).nodes[0].key
    assert sum(root in r.seen for r in pages) == MIN_PAGES  # different pages are told apart up to this


@pytest.mark.parametrize("most", [0, 40])
def test_rows_handed_on_in_parts_count_the_same(spark, most):
    pages = prepared(spark, site("a.example", 9) * 2 + [own(i, OFFER) for i in range(9)])
    number = F.least("pages", F.lit(MIN_PAGES)).alias("pages")
    whole, parts = (
        sorted(importance(_counted(_trees(pages, n))).select("key", number, "styles", F.round("imp", 12)).collect())
        for n in (10**9, most)
    )
    assert len(whole) > 20 and whole == parts
