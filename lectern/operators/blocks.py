"""Texts to ordered, labelled blocks, and boilerplate blocks out of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.arrays import let, running
from lectern.schema import BLOCKS

ITEM = "struct<kind:string,text:string,level:int>"

# Fixed patterns of boilerplate blocks.
BANNER = r"(?iU)^\s*The Project Gutenberg eBook of\b"
FIELD = r"(?iU)^\s*(title|author|translator|illustrator|editor|contributor|release date|language|credits|original publication|most recently updated)\s*:"
LICENCE = r"(?iU)(full\W+project\W+gutenberg\W+licen[sc]e|end of\W+(the\W+)?project\W+gutenberg|start:?\W+full\W+licen[sc]e)"


def exploded(rows: DataFrame, items: Column) -> DataFrame:
    """One row per item (struct kind, text, level) of each row's array, numbered from 0."""
    out = rows.select("doc_id", F.posexplode(items).alias("block_idx", "b"))
    return out.select("doc_id", "block_idx", "b.kind", "b.text", "b.level", F.lit(None).cast("int").alias("page"))


def plain_items(text: Column, detect_headings: bool = True) -> Column:
    """Plain text by blank lines; lone heading-like lines are headings of level 2."""
    paragraphs = F.split(T.blank_lines_collapsed(text), "\n\n", -1)

    def item(p: Column) -> Column:
        body = T.strip(T.sub(T.unwrapped(p), " +", " "))
        paragraph = F.struct(F.lit("paragraph").alias("kind"), body.alias("text"), F.lit(0).alias("level"))
        heading = F.struct(F.lit("heading").alias("kind"), T.strip(p).alias("text"), F.lit(2).alias("level"))
        return F.when(T.heading_like(p), heading).otherwise(paragraph) if detect_headings else paragraph

    return F.filter(F.transform(paragraphs, item), lambda b: b["text"] != "")


def plain_blocks(docs: DataFrame, detect_headings: bool = True) -> DataFrame:
    return exploded(docs, plain_items(F.col("text"), detect_headings))


def without_boilerplate(blocks: DataFrame) -> DataFrame:
    """Blocks between the start mark (or a banner and the fields after it) and the end mark (or the
    licence heading). A document that this would empty stays as it is."""
    b = blocks.withColumn("has_start", F.instr("text", T.START_MARK) > 0).withColumn("has_end", F.instr("text", T.END_MARK) > 0)
    whole = Window.partitionBy("doc_id")
    least = lambda c: F.min(F.when(c, F.col("block_idx"))).over(whole)
    first = F.col("block_idx") == 0
    b = b.withColumns({
        "start": least(F.col("has_start")), "banner": least(first & F.col("text").rlike(BANNER)),
        "field_end": least(~first & ~F.col("text").rlike(FIELD)), "size": F.max("block_idx").over(whole) + 1,
        "end": least(F.col("has_end")), "licence": least((F.col("kind") == "heading") & F.col("text").rlike(LICENCE)),
    })
    begin = F.when(F.col("start").isNotNull(), F.col("start") + 1).when(F.col("banner").isNotNull(), F.coalesce("field_end", "size")).otherwise(0)
    end = F.coalesce("end", "licence", "size")
    inside = (F.col("block_idx") >= begin) & (F.col("block_idx") < end)
    return b.where(inside | (begin >= end)).select(*blocks.columns)


def sparse(blocks: DataFrame, least: int = 200) -> DataFrame:
    """Documents with pages that have few spoken characters per page: doc_id, pages, spoken_chars, escalate."""
    chars = F.sum(F.when(T.spoken(F.col("kind"), F.col("text")), F.length("text")).otherwise(0))
    out = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), chars.cast("long").alias("spoken_chars"))
    return out.withColumn("escalate", (F.col("pages") > 0) & (F.col("spoken_chars") / F.col("pages") < least))


# -- Markdown ----------------------------------------------------------------------------------

# Fixed patterns of lines, by what they make of a line; inline markup is ``T.drop_inline_markup``.
FENCE, IMAGE = r"(?U)^\s*(```|~~~)", r"(?U)^\s*!\[[^\]]*\]\([^)]*\)\s*$"
RULE, ATX = r"(?U)^\s*(?:[-*_]\s*){3,}$", r"(?U)^(#{1,6})\s+(.*?)\s*#*\s*$"
UNDER_1, UNDER_2 = r"(?U)^=+\s*$", r"(?U)^-{2,}\s*$"
ROW, QUOTE, LIST = r"(?U)^\s*\|.*\|\s*$", r"(?U)^\s*>\s?", r"(?U)^\s*(?:[-*+]|\d{1,3}[.)])\s+"
#: A line that begins like this is none of the above.
ORDINARY = r"(?U)^\s*[^\s`~!#|>=+*_\-\d]"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: What may be open before a line, as a digit.
NOTHING, PARAGRAPH, TABLE, QUOTED, LISTED, CODE = "012345"
STATES = "012345"
#: What each sort of line leaves open after each of STATES. A plain line goes on with a paragraph, a
#: quote or a list and ends a table; code goes on until a fence.
AFTER = {"fence": "555550", "end": "000005", "table": "222225", "quote": "333335", "list": "444445", "plain": "111345"}


def line_sorts(line: Column) -> Column:
    """What a line leaves open after each of STATES.

    A rule is nothing where nothing is open, an underline turns an open paragraph into a heading;
    elsewhere both are what they otherwise look like.
    """
    text = F.when(line.rlike(ROW), AFTER["table"]).when(line.rlike(QUOTE), AFTER["quote"]).when(line.rlike(LIST), AFTER["list"]).otherwise(AFTER["plain"])
    ruled = F.when(line.rlike(RULE), F.overlay(text, F.lit(NOTHING), 1)).otherwise(text)
    under = F.when(line.rlike(UNDER_1) | line.rlike(UNDER_2), F.overlay(ruled, F.lit(NOTHING), 2)).otherwise(ruled)
    ends = (T.strip(line) == "") | line.rlike(ATX) | line.rlike(IMAGE)
    return F.when(line.rlike(ORDINARY), AFTER["plain"]).when(line.rlike(FENCE), AFTER["fence"]).when(ends, AFTER["end"]).otherwise(under)


def markdown_structs(text: Column) -> Column:
    """Markdown as an array of ITEM.

    Each line is a function from what is open before it to what is open after it, a string of six
    digits; such functions compose, so what is open before a line is a running composition of the
    lines before. A block starts where something opens that wasn't open and holds the lines up to
    the next start that go on with it.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_ENDS, -1), lambda x: F.struct(x.alias("text"), line_sorts(x).alias("sort")))
    compose = lambda f, g: F.call_function("translate", f, F.lit(STATES), g)
    opened = lambda ls: running(F.transform(ls, lambda x: x["sort"]), compose, F.lit(STATES), "string")

    def told(line: Column, before: Column) -> Column:
        was = F.substring(before, 1, 1)
        now = F.substring(line["sort"], was.cast("int") + 1, F.lit(1))
        fence = line["sort"] == AFTER["fence"]
        alone = (line["sort"] == AFTER["end"]) & (was != CODE) & (T.strip(line["text"]) != "")
        starts = alone | ((now != was) & (now != NOTHING))
        part = F.when(was == CODE, ~fence).otherwise(alone | ((now != NOTHING) & ~fence))
        under = (was == PARAGRAPH) & (now == NOTHING) & (line["sort"] != AFTER["end"])
        return F.struct(line["text"].alias("text"), now.alias("now"), alone.alias("alone"), starts.alias("starts"), part.alias("part"), under.alias("under"))

    def cut(ls: Column) -> Column:
        first = F.filter(F.transform(ls, lambda x, k: F.when(x["starts"], k + 1)), lambda k: k.isNotNull())
        until = lambda ks: F.concat(F.slice(ks, 2, F.greatest(F.size(ks) - 1, F.lit(0))), F.array(F.size(ls) + 1))
        return let(first, lambda ks: F.zip_with(ks, until(ks), lambda a, b: let(F.slice(ls, a, b - a), item)))

    def item(ls: Column) -> Column:
        head = F.element_at(ls, 1)
        raw = F.transform(F.filter(ls, lambda x: x["part"]), lambda x: x["text"])
        line, state = head["text"], head["now"]
        marker = F.when(state == QUOTED, QUOTE).otherwise(LIST)
        plain = lambda unmarked: T.drop_inline_markup(F.array_join(F.transform(raw, lambda x: T.strip(unmarked(x))), " "))
        # a marker may be there once in a line; lazy lines have none
        words = F.when(state.isin(QUOTED, LISTED), plain(lambda x: F.regexp_replace(x, marker, F.lit("")))).otherwise(plain(lambda x: x))
        under = F.exists(ls, lambda x: x["under"])
        level = F.when(F.exists(ls, lambda x: x["under"] & x["text"].rlike(UNDER_1)), 1).otherwise(2)
        of = lambda kind, body, n: F.struct(F.lit(kind).alias("kind"), body.alias("text"), n.cast("int").alias("level"))
        flat = F.lit(0)
        return (
            F.when(head["alone"] & line.rlike(IMAGE), of("figure", T.strip(line), flat))
            .when(head["alone"], of("heading", T.drop_inline_markup(F.regexp_extract(line, ATX, 2)), F.length(F.regexp_extract(line, ATX, 1))))
            .when(state == CODE, of("code", T.strip(F.array_join(raw, "\n")), flat))
            .when(state == TABLE, of("table", T.strip(F.array_join(raw, "\n")), flat))
            .when(state == QUOTED, of("quote", words, flat))
            .when(state == LISTED, of("list", words, flat))
            .when(under, of("heading", words, level))
            .otherwise(of("paragraph", words, flat))
        )

    found = let(lines, lambda ls: let(F.zip_with(ls, opened(ls), told), cut))
    return F.filter(found, lambda x: x["text"] != "")


# -- by a parser, and from the blocks ------------------------------------------------------------


def parsed_blocks(docs: DataFrame, parse) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text) by a Python parser, in Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(d, k, kind, text, level, None) for d, t in zip(part["doc_id"], part["text"]) for k, (kind, text, level) in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "block_idx", "kind", "text", "level", "page"]).astype({"page": "Int32"})

    return docs.select("doc_id", "text").mapInPandas(run, BLOCKS)


def markdown_blocks(docs: DataFrame) -> DataFrame:
    return exploded(docs, markdown_structs(F.col("text")))


def title_of(blocks: DataFrame) -> DataFrame:
    """The first heading of level 1 of each document: doc_id, title."""
    top = blocks.where((F.col("kind") == "heading") & (F.col("level") == 1))
    return top.groupBy("doc_id").agg(F.min_by("text", "block_idx").alias("title"))


def first_h1(page: Column) -> Column:
    """The text of a page's first h1, tags dropped."""
    inner = F.regexp_extract(page, r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    return F.trim(T.sub(T.sub(inner, "<[^>]+>", " "), r"\s+", " "))


