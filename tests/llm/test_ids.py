"""Ids that are no whole numbers: an error in every operator, whether Spark's ANSI mode is on or off, never a null and a lost row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphmine.llm import capture_index, decontaminate, exact_dedup, html_extract, langid, lm_scoring, ngram_join, packing, sharding, sstable

from . import cases

DOCS, PAGES = "doc_id string, text string, lang string", "page_id string, url string, html string"
RUNS = {
    "op1": lambda d, p, b: packing.pack_documents(d), "op2": lambda d, p, b: ngram_join.similar_documents(d), "op3": lambda d, p, b: lm_scoring.score(d), "op4": lambda d, p, b: html_extract.extract_pages(p),
    "op5": lambda d, p, b: sstable.tables(d), "op6": lambda d, p, b: capture_index.capture_index(p), "op7": lambda d, p, b: exact_dedup.exact_owners(d), "op8": lambda d, p, b: langid.identify(d),
    "op9": lambda d, p, b: decontaminate.find_leaks(d, b), "op10": lambda d, p, b: sharding.shard(d, F.col("text")),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_text_ids_are_refused(spark, name):
    docs = cases.table(spark, [("a-1", cases.PLAIN, "en"), ("7", cases.PLAIN, "en")], DOCS)
    pages = cases.table(spark, [("a-1", "http://a.b/", "<p>x")], PAGES)
    benchmark = cases.table(spark, [(1, cases.PLAIN)], "item_id long, text string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="must hold whole numbers"):
            RUNS[name](docs, pages, benchmark).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
