"""Files of documents by suffix, EPUB archives, voice lists; sinks of texts and manifests."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import blocks as B
from lectern.operators.html import html_blocks
from lectern.sources import epub

#: What a suffix is read as.
READERS = {".txt": "text", ".text": "text", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".epub": "epub", ".pdf": "pdf"}

#: A book's record in a catalogue.
BOOK = "id long, title string, authors array<struct<name: string>>, languages array<string>, download_count long, copyright boolean, formats map<string, string>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/", -1), -1), r"(?<=.)\.[^.]*$", "")


def reader_of(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in READERS.items() for x in pair]), suffix(path))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder and below: doc_id, path, reader (null: unsupported), content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", reader_of(F.col("path")).alias("reader"), "content")


def text_of(content: Column) -> Column:
    """A file's text, line ends as line feeds; null if it isn't UTF-8."""
    return F.replace(F.try_validate_utf8(content.cast("string")), F.lit("\r\n"), F.lit("\n"))


def blocks(docs: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Blocks of files as ``documents`` gives them, boilerplate left out. Files that can't be read give none.

    ``chapters`` (of ``epub.chapters_of_folder``) saves reading EPUBs whole.
    """
    text = docs.withColumn("text", text_of(F.col("content"))).where("text is not null")
    of = lambda kind: text.where(F.col("reader") == kind)
    plain = of("text").withColumn("text", F.when(T.mentions(F.col("text")) > 5, T.without_boilerplate(F.col("text"))).otherwise(F.col("text"))).where("text is not null")
    books = epub.blocks(epub.chapters_of_content(docs.where(F.col("reader") == "epub")) if chapters is None else chapters)
    out = B.plain_blocks(plain).unionByName(B.markdown_blocks(of("markdown"))).unionByName(html_blocks(of("html"))).unionByName(books)
    return B.without_boilerplate(out)


def _archive_error(content: Column) -> Column:
    @F.pandas_udf("string")
    def errors(contents: pd.Series) -> pd.Series:
        def tried(data: bytes) -> str | None:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    damaged = z.testzip()
                    packaged = epub.CONTAINER in z.namelist() and b"full-path" in z.read(epub.CONTAINER)
            except Exception as error:  # told, not raised
                return f"unreadable archive: {type(error).__name__}: {error}"
            return f"unreadable archive: damaged entry {damaged}" if damaged else None if packaged else "unreadable archive: no package"

        return contents.map(tried)

    return errors(content)


def rejected(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Files that gave nothing to speak: path, reason, error (what keeps a file from being read). Errors are looked into for these only."""
    speaking = found.where(T.spoken(F.col("kind"), F.col("text"))).select("doc_id").distinct()
    out = docs.join(speaking, "doc_id", "left_anti").withColumn("reason", F.when(F.col("reader").isNull(), "unsupported suffix").otherwise("nothing to speak"))
    coded = F.col("reader").isin("text", "markdown", "html") & text_of(F.col("content")).isNull()
    error = F.when(coded, "not UTF-8 text").when(F.col("reader") == "pdf", "needs an extractor")
    epubs = out.where("reader <=> 'epub'").select("path", "reason", _archive_error(F.col("content")).alias("error"))
    return out.where("not (reader <=> 'epub')").select("path", "reason", error.alias("error")).unionByName(epubs)


def required(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found``, for a run that takes no exception: raises if a file gave nothing to speak. This reads the files once more."""
    said = F.concat("path", F.lit(": "), F.coalesce("error", "reason"))
    bad = rejected(docs, found).agg(F.count(F.lit(1)).alias("n"), F.min(said).alias("said")).first()
    if bad.n:
        raise ValueError(f"nothing to speak in {bad.n} files, such as {bad.said}")
    return found


def voice_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A voice list (name,language,locale,gender,"tags", no header) as VOICES."""
    rows = spark.read.csv(path, schema="id string, language string, locale string, gender string, tags string", quote='"', mode="DROPMALFORMED")
    name = F.regexp_replace(F.element_at(F.split(F.trim("id"), "-", -1), -1), "Neural$", "")
    some = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return rows.where("gender is not null").select(F.trim("id").alias("id"), F.lit("edge").alias("engine"), F.when(name != "", name).otherwise(F.col("id")).alias("name"), *[some(c).alias(c) for c in ("language", "locale", "gender", "tags")])


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Book records from JSON lines, as ``search`` takes them."""
    return book_records(spark.read.schema(BOOK).json(path), F.col("id"))


def book_records(rows: DataFrame, ord: Column, keep: list[str] | None = None) -> DataFrame:
    """Records as catalogues give them (columns BOOK), in the form ``search`` takes, beside the columns ``keep``."""
    from lectern.functions.catalog import author_name

    formats = F.transform(F.map_entries(F.coalesce("formats", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("mime"), e["value"].alias("url")))
    authors = F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: author_name(a["name"]))
    return rows.select(*(keep or []), "id", T.strip(F.coalesce("title", F.lit(""))).alias("title"), authors.alias("authors"), F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), F.coalesce("download_count", F.lit(0)).alias("download_count"), F.col("copyright").alias("copyrighted"), formats.alias("formats"), ord.alias("ord"))


def write_texts(rows: DataFrame, folder: str, column: str, buckets: int = 64) -> None:
    """Texts as JSON lines (doc_id, text) in ``buckets`` folders by hash of the document: files don't grow with documents."""
    out = rows.select("doc_id", F.col(column).alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    out.write.partitionBy("bucket").json(folder)


def write_voice_list(voices: DataFrame, path: str) -> None:
    """The voice list as sorted lines without header, in files whose names sort as their lines do."""
    from lectern.operators.library import voice_list

    voice_list(voices).orderBy("place").select("line").write.mode("overwrite").text(path)
