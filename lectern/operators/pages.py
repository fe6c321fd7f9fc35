"""Pages of documents whose text comes from several backends: ranges, tiers, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import printable, strip

#: Annotations that mark text (highlight, underline); others carry their note alone.
MARKING = (8, 9)


def page_range(pages: DataFrame, first: Column | int | None = None, last: Column | int | None = None) -> DataFrame:
    """Pages ``first`` to ``last``, counted from 1, both included and clamped; 0 or null is no bound."""
    bound = lambda x, otherwise: F.coalesce(F.nullif(x if isinstance(x, Column) else F.lit(x).cast("int"), F.lit(0)), F.lit(otherwise))
    return pages.where((F.col("page") >= F.greatest(F.lit(1), bound(first, 1))) & (F.col("page") <= bound(last, 2**31 - 1)))


def tiers(pages: DataFrame, force_ocr: bool = False) -> DataFrame:
    """The text of each page from the first backend that has some: doc_id, page, tier, text, ocr_error.

    ``pages``: doc_id, page, layout (a layout backend's Markdown), plain (the text layer), ocr,
    ocr_error (why OCR failed on that page). A document that a layout backend has read at all isn't
    read from its text layer. After the first page of a document on which OCR fails no page of it is
    read by OCR; the failure is told on that page only. Tier: layout, text, ocr or none.
    """
    some = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    doc = Window.partitionBy("doc_id")
    by_layout = F.max(F.col("layout").isNotNull()).over(doc)
    plain, ocr = printable(F.col("plain")), printable(F.col("ocr"))
    early = F.when(F.lit(force_ocr), F.lit(None)).when(some(F.col("layout")), "layout").when(~F.col("_laid") & some(plain), "text")
    rows = pages.withColumn("_laid", F.coalesce(by_layout, F.lit(False))).withColumn("_early", early)
    rows = rows.withColumn("_failed", F.min(F.when(F.col("_early").isNull() & F.col("ocr_error").isNotNull(), F.col("page"))).over(doc))
    open_ = F.col("_failed").isNull() | (F.col("page") < F.col("_failed"))
    tier = F.coalesce("_early", F.when(open_ & some(ocr), "ocr"), F.lit("none"))
    text = F.when(F.col("tier") == "layout", F.col("layout")).when(F.col("tier") == "text", plain).when(F.col("tier") == "ocr", ocr)
    told = F.when(F.col("page") == F.col("_failed"), F.col("ocr_error"))
    return rows.withColumn("tier", tier).select("doc_id", "page", "tier", text.alias("text"), told.alias("ocr_error"))


def annotations(found: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Annotations (doc_id, page, kind, name, text, color, note) in a range of pages; only marks keep text and colour."""
    marks = F.col("kind").isin(*MARKING)
    rows = page_range(found, first, last)
    return rows.select("doc_id", "page", F.col("name").alias("type"), F.when(marks, strip(F.col("text"))).alias("text"), F.when(marks, F.col("color")).alias("color"), "note")
