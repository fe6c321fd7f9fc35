"""Running headers, footers and page numbers among the blocks of paged documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip

#: Keys of this length and longer don't recur; documents with fewer pages are left alone.
LONGEST, LEAST_PAGES, LEAST_COUNT = 120, 4, 3
PAGE_NUMBER = r"(?U)\A[\s\divxlcIVXLC.\-—–]+\z"


def page_edges(blocks: DataFrame) -> DataFrame:
    """The first and last block of each page: the columns of ``blocks``, edge (head or foot), key.

    A page's only block is both. Blocks without page are left out.
    """
    page = Window.partitionBy("doc_id", "page")
    b = blocks.where("page is not null").withColumns({"_first": F.min("block_idx").over(page), "_last": F.max("block_idx").over(page)})
    sides = F.filter(F.array(F.when(F.col("block_idx") == F.col("_first"), F.lit("head")), F.when(F.col("block_idx") == F.col("_last"), F.lit("foot"))), lambda s: s.isNotNull())
    return b.withColumn("edge", F.explode(sides)).withColumn("key", F.substring(strip(F.col("text")), 1, LONGEST)).drop("_first", "_last")


def recurring_edges(edges: DataFrame) -> DataFrame:
    """Keys that recur at one edge on a quarter of the pages and at least three: doc_id, key."""
    pages = edges.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    counts = edges.where(F.length("key").between(1, LONGEST - 1)).groupBy("doc_id", "edge", "key").agg(F.count("*").alias("n"))
    enough = F.col("n") >= F.greatest(F.lit(LEAST_COUNT), F.floor(F.col("pages") / 4))
    return counts.join(pages, "doc_id").where(enough).select("doc_id", "key").distinct()


def _is_artifact(text: Column, recurs: Column) -> Column:
    """The whole block is a page number; its key, which is cut, only tells whether it recurs."""
    return recurs | strip(text).rlike(PAGE_NUMBER)


def marked(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the kind page_artifact for running headers, footers and page numbers."""
    edges = page_edges(blocks)
    enough = edges.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= LEAST_PAGES).select("doc_id")
    recurring = recurring_edges(edges).withColumn("recurs", F.lit(True))
    found = edges.join(enough, "doc_id", "left_semi").join(recurring, ["doc_id", "key"], "left")
    found = found.where(_is_artifact(F.col("text"), F.coalesce("recurs", F.lit(False)))).select("doc_id", "block_idx", F.lit(True).alias("_hit")).distinct()
    out = blocks.join(found, ["doc_id", "block_idx"], "left")
    kind = F.when(F.col("_hit"), "page_artifact").otherwise(F.col("kind"))
    return out.select(*[kind.alias("kind") if c == "kind" else F.col(c) for c in blocks.columns])
