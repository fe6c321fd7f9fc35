"""EPUBs from the entries of their archives: the package is read, its spine resolved and chapters read as HTML.

Everything is a join of tables with a row per entry, from the ``lectern_archive`` format or from
archives held as content. A package that isn't XML has no spine, hence no chapters.
"""

from __future__ import annotations

import contextlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import html
from lectern.sources import archive

CONTAINER = "META-INF/container.xml"
#: Suffixes of what a spine may name.
CHAPTERS = (".xhtml", ".html", ".htm", ".xml")
_ROOTS = "rootfiles struct<rootfile: array<struct<`_full-path`: string>>>"
_PACKAGE = "manifest struct<item: array<struct<_id: string, _href: string>>>, spine struct<itemref: array<struct<_idref: string>>>"
_ENTRY = "doc_id long, entry string, content binary"
#: How many steps up a path in a package may take.
STEPS_UP = 8


def resolved(folder: Column, href: Column) -> Column:
    """The entry that a package in ``folder`` (ending with a slash, or empty) means."""
    plain = F.try_url_decode(F.replace(F.split_part(href, F.lit("#"), F.lit(1)), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(F.concat(F.lit("/"), folder, F.coalesce(plain, href)), r"/(\./)+", "/")
    for _ in range(STEPS_UP):
        path = F.regexp_replace(path, r"/(?!\.\./)[^/]+/\.\./", "/")
    return F.regexp_replace(path, r"\A/+", "")


def _xml(content: Column, schema: str) -> Column:
    return F.from_xml(F.make_valid_utf8(content.cast("string")), schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def spines(packages: DataFrame, containers: DataFrame) -> DataFrame:
    """Entries of the spine in order (doc_id, chapter, entry) from package and container files (doc_id, entry, content)."""
    root = F.get(F.filter(_xml(F.col("content"), _ROOTS)["rootfiles"]["rootfile"], lambda x: x["_full-path"].isNotNull()), F.lit(0))["_full-path"]
    roots = containers.select("doc_id", root.alias("entry")).where("entry is not null")
    p = packages.join(roots, ["doc_id", "entry"]).select("doc_id", F.regexp_extract("entry", r"\A(.*/)?", 0).alias("folder"), _xml(F.col("content"), _PACKAGE).alias("p"))
    refs = p.select("doc_id", "folder", "p.manifest.item", F.posexplode("p.spine.itemref").alias("chapter", "ref"))
    href = F.get(F.filter("item", lambda i: i["_id"] == F.col("ref._idref")), F.lit(0))["_href"]
    return refs.select("doc_id", "chapter", resolved(F.col("folder"), href).alias("entry")).where("entry is not null")


def chapters(found: DataFrame, packages: DataFrame, containers: DataFrame) -> DataFrame:
    """Chapters (doc_id, chapter, entry, text) out of the entries ``found``."""
    own = found.select("doc_id", "entry", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return spines(packages, containers).join(own, ["doc_id", "entry"])


def blocks(chapters: DataFrame) -> DataFrame:
    """Chapters to BLOCKS, numbered through a document."""
    rows = chapters.select("doc_id", "chapter", F.posexplode(html.html_structs(F.col("text"))).alias("n", "b"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter", "n")) - 1
    return rows.select("doc_id", place.cast("int").alias("block_idx"), "b.kind", "b.text", "b.level", F.lit(None).cast("int").alias("page"))


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files, which is written in several ways."""
    return F.regexp_replace(path, r"\Afile:/+", "/")


def chapters_of_folder(spark: SparkSession, folder: str, docs: DataFrame, **options: str) -> DataFrame:
    """Chapters of the EPUBs at ``folder`` that are among ``docs`` (doc_id, path); only packages and chapters are read."""
    ids = docs.select("doc_id", plain_path(F.col("path")).alias("path"))

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(plain_path(F.col("path")).alias("path"), "entry", "content").join(ids, "path").select("doc_id", "entry", "content")

    read = lambda **more: archive.entries(spark, folder, archives=".epub", **options, **more)
    return chapters(named(read(suffixes=",".join(CHAPTERS))), named(read().where(F.endswith("entry", F.lit(".opf")))), named(read().where(F.col("entry") == CONTAINER)))


def unpacked(docs: DataFrame) -> DataFrame:
    """Entries (doc_id, entry, content) of archives held as content; of one that can't be read, none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc_id, content in zip(part["doc_id"], part["content"]):
                rows = []
                with contextlib.suppress(Exception), zipfile.ZipFile(io.BytesIO(content)) as z:  # a damaged archive is data
                    for name in z.namelist():
                        if name.lower().endswith((*CHAPTERS, ".opf")):
                            with contextlib.suppress(Exception):  # and so is a damaged entry
                                rows.append((doc_id, name, z.read(name)))
                yield pd.DataFrame(rows, columns=["doc_id", "entry", "content"])

    return docs.select("doc_id", "content").mapInPandas(run, _ENTRY)


def chapters_of_content(docs: DataFrame) -> DataFrame:
    """Chapters of EPUBs (doc_id, content)."""
    found = unpacked(docs)
    return chapters(found, found.where(F.endswith("entry", F.lit(".opf"))), found.where(F.col("entry") == CONTAINER))
