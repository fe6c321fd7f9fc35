r"""HTML to labelled blocks, as DataFrame functions.

A page is cut at its tags into an array: each tag with the text after it. Comments, declarations,
scripts and styles are tags of no meaning; what lies inside ``nav`` is left out, as is what lies
outside the body. How many lists, quotes, tables and code blocks are open before a tag is a running
count that never falls below zero. Which block is open before a tag is a running composition: every
tag is a function from the block open before it to the one open after it, a string of a sign per
possible block, and such functions compose by translating one by the other.

Block tags inside a quote, table, code block or list item belong to its text, and its end is the end
tag that brings its depth back to zero. A list item also ends where the next item of its list begins
or its list ends. A paragraph ends at the next block tag; block tags inside headings and captions
are their text. A page without blocks is one paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import let, running
from lectern.functions.text import REFERENCE, unescaped
from lectern.operators.blocks import exploded

# What tags become.
BLOCK_TAGS = {
    "p": ("paragraph", 0), "h1": ("heading", 1), "h2": ("heading", 2), "h3": ("heading", 3), "h4": ("heading", 4), "h5": ("heading", 5), "h6": ("heading", 6),
    "figcaption": ("figure", 0), "blockquote": ("quote", 0), "table": ("table", 0), "pre": ("code", 0), "li": ("list", 0),
}
LISTS = ("ul", "ol", "menu")

#: Comments (also unclosed ones), scripts and styles with their content, tags (with up to a hundred quoted values), other markup.
TAG = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+'){0,200}+>|<[!?/a-z][^>]*(?:>|\z)"""
NAME = r"(?i)\A</?([a-z][a-z0-9]*)"
SPACE = r"(?U)[\s\x1c-\x1f]+"

#: A sign per block that may be open; the first is none.
OPEN = "0123456789ABC"
NONE, SIGN = "0", dict(zip(BLOCK_TAGS, "123456789ABC"))
PARAGRAPH, ITEM = SIGN["p"], SIGN["li"]
#: What is open after a start tag and after an end tag, for each of OPEN: blocks open in no block or in a paragraph.
STARTS = {tag: sign + sign + OPEN[2:] for tag, sign in SIGN.items()}
ENDS = {tag: OPEN.replace(sign, NONE) for tag, sign in SIGN.items()}

#: What is counted as a tag's depth: lists together, holders each for itself.
COUNTED = {"lists": LISTS, "quotes": ("blockquote",), "tables": ("table",), "codes": ("pre",)}
HOLDS = {"blockquote": "quotes", "table": "tables", "pre": "codes"}


def _is(tag: Column, *names: str) -> Column:
    return tag["name"].isin(*names)


def _ends(names: tuple[str, ...]) -> list[str]:
    return [f"/{n}" for n in names]


def _step(tag: Column, names: tuple[str, ...]) -> Column:
    return F.when(_is(tag, *names), 1).when(_is(tag, *_ends(names)), -1).otherwise(0)


def _depths(tags: Column, counted: dict[str, tuple[str, ...]]) -> Column:
    """For each tag the depths before it: a depth is the function greatest(least, depth + change), and such functions compose."""
    fields = lambda of: F.struct(*[x.alias(n) for c in counted for n, x in zip((f"{c}_least", c), of(c))])
    values = F.transform(tags, lambda t: fields(lambda c: (F.lit(0), _step(t, counted[c]))))
    compose = lambda f, g: fields(lambda c: (F.greatest(g[f"{c}_least"], f[f"{c}_least"] + g[c]), f[c] + g[c]))
    return running(values, compose, fields(lambda c: (F.lit(0), F.lit(0))), "struct<{}>".format(",".join(f"{c}_least:int,{c}:int" for c in counted)))


def _before(depth: Column, c: str) -> Column:
    return F.greatest(depth[f"{c}_least"], depth[c])


def _after(tag: Column, depth: Column, c: str, names: tuple[str, ...]) -> Column:
    return F.greatest(F.lit(0), _before(depth, c) + _step(tag, names))


def tags_of(page: Column) -> Column:
    """The tags of a page's body outside ``nav``: array of struct name (an end tag's begins with a slash), text (what follows).

    A first one without name holds what precedes any tag.
    """
    name = lambda tag: F.concat(F.when(F.startswith(tag, F.lit("</")), "/").otherwise(""), F.lower(F.regexp_extract(tag, NAME, 1)))
    cut = lambda p: F.zip_with(F.concat(F.array(F.lit("")), F.regexp_extract_all(p, F.lit(TAG), F.lit(0))), F.split(p, TAG, -1), lambda tag, text: F.struct(name(tag).alias("name"), text.alias("text")))
    place = lambda tags, name: F.array_position(F.transform(tags, lambda t: t["name"]), name).cast("int")

    def body(tags: Column) -> Column:
        first, last = F.greatest(place(tags, "body"), F.lit(1)), place(tags, "/body")
        return F.slice(tags, first, F.when(last > first, last - first).otherwise(F.size(tags)))

    def seen(tags: Column) -> Column:
        nav = {"nav": ("nav",)}
        both = lambda ds: F.zip_with(tags, ds, lambda t, d: F.struct(t.alias("t"), d.alias("d")))
        outside = let(_depths(tags, nav), lambda ds: F.transform(F.filter(both(ds), lambda x: _after(x["t"], x["d"], "nav", nav["nav"]) == 0), lambda x: x["t"]))
        return F.when(F.exists(tags, lambda t: _is(t, "nav")), outside).otherwise(tags)

    return let(let(let(F.coalesce(page, F.lit("")), cut), body), seen)


def _flat_sort(tag: Column) -> Column:
    """What a tag leaves open, for each of OPEN, where no depth has a say."""
    known = {**STARTS, **{f"/{t}": s for t, s in ENDS.items()}}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, tag["name"]), F.lit(OPEN))


def _sort(tag: Column, depth: Column) -> Column:
    """What a tag leaves open, for each of OPEN: holders end at depth zero, items by those of the outermost list."""
    inner = _is(tag, "/li") & (_before(depth, "lists") > 1)
    for name, c in HOLDS.items():
        inner = inner | (_is(tag, f"/{name}") & (_after(tag, depth, c, COUNTED[c]) > 0))
    ends_list = _is(tag, *_ends(LISTS)) & (_after(tag, depth, "lists", LISTS) == 0)
    return F.when(inner, OPEN).when(ends_list, ENDS["li"]).otherwise(_flat_sort(tag))


def words(text: Column) -> Column:
    """Text with its references resolved, words apart by one blank."""
    return F.trim(F.regexp_replace(unescaped(text), SPACE, " "))


def html_structs(page: Column) -> Column:
    """A page's blocks: array of struct kind, text, level."""
    compose = lambda f, g: F.call_function("translate", f, F.lit(OPEN), g)
    kind, level = ({SIGN[t]: x[k] for t, x in BLOCK_TAGS.items()} for k in (0, 1))
    among = lambda sign, values: F.get(F.array(*[F.lit(v) for v in values.values()]), F.instr(F.lit("".join(values)), sign) - 1)
    joined = lambda tags: F.array_join(F.transform(tags, lambda t: t["text"]), " ")
    block = lambda kind, text, level: F.struct(kind.alias("kind"), text.alias("text"), level.cast("int").alias("level"))

    def sorted_(tags: Column) -> Column:
        told = lambda t, sort, item: F.struct(t["text"].alias("text"), sort.alias("sort"), F.when(_is(t, "p"), PARAGRAPH).when(_is(t, "li") & item, ITEM).alias("again"))
        deep = let(_depths(tags, COUNTED), lambda ds: F.zip_with(tags, ds, lambda t, d: told(t, _sort(t, d), _before(d, "lists") <= 1)))
        held = F.exists(tags, lambda t: _is(t, *LISTS, *HOLDS))
        return F.when(held, deep).otherwise(F.transform(tags, lambda t: told(t, _flat_sort(t), F.lit(True))))

    def opened(tags: Column) -> Column:
        def told(t: Column, before: Column) -> Column:
            was = F.substring(before, 1, 1)
            now = F.substring(t["sort"], F.instr(F.lit(OPEN), was), F.lit(1))
            starts = (now != NONE) & ((now != was) | F.coalesce(t["again"] == now, F.lit(False)))
            return F.struct(t["text"].alias("text"), now.alias("now"), starts.alias("starts"))

        return let(running(F.transform(tags, lambda t: t["sort"]), compose, F.lit(OPEN), "string"), lambda before: F.zip_with(tags, before, told))

    def cut(tags: Column) -> Column:
        first = F.filter(F.transform(tags, lambda t, k: F.when(t["starts"], k + 1)), lambda k: k.isNotNull())
        until = lambda ks: F.concat(F.slice(ks, 2, F.greatest(F.size(ks) - 1, F.lit(0))), F.array(F.size(tags) + 1))
        own = lambda ts: let(F.element_at(ts, 1)["now"], lambda sign: block(among(sign, kind), joined(F.filter(ts, lambda t: t["now"] == sign)), among(sign, level)))
        found = let(first, lambda ks: F.zip_with(ks, until(ks), lambda a, b: let(F.slice(tags, a, b - a), own)))
        whole = block(F.lit("paragraph"), joined(tags), F.lit(-1))
        some = F.when(F.size(first) > 0, found).otherwise(F.slice(F.array(whole), 1, 0))
        return let(some, lambda blocks: F.when(F.exists(blocks, lambda b: F.regexp_replace(b["text"], f"{REFERENCE}|{SPACE}", "") != ""), blocks).otherwise(F.concat(blocks, F.array(whole))))

    def told(blocks: Column) -> Column:
        """Blocks with their words; the whole page (level -1) counts if all others are empty."""
        said = F.transform(blocks, lambda b: block(b["kind"], words(b["text"]), b["level"]))
        own = lambda bs: F.filter(bs, lambda b: b["level"] >= 0)
        page = lambda bs: F.transform(bs, lambda b: block(b["kind"], b["text"], F.lit(0)))
        return let(F.filter(said, lambda b: b["text"] != ""), lambda bs: F.when(F.exists(bs, lambda b: b["level"] >= 0), own(bs)).otherwise(page(bs)))

    return told(let(let(let(tags_of(page), sorted_), opened), cut))


def html_blocks(docs: DataFrame) -> DataFrame:
    return exploded(docs, html_structs(F.col("text")))
