"""Catalogue search, voice lists and the job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import catalog as C
from lectern.functions.text import strip


def search(books: DataFrame, title: str, author: str | None = None, limit: int = 10) -> DataFrame:
    """The best matches: rank, then the columns of ``books`` (which has ord, the order of equals).

    Every needle of the author must occur in the authors' names, unless no book then is left. Only
    books with a format count; relevance, then epub, then downloads decide. Ranks come from a
    top-k, not a sort of the table.
    """
    b = books
    if author:
        needles = [n for n in author.lower().replace(",", " ").split() if len(n) > 1]
        name = F.lower(F.coalesce(F.when(F.size("authors") > 0, F.array_join("authors", ", ")), F.lit("Unknown")))
        fits = F.lit(True)
        for n in needles:
            fits = fits & F.contains(name, F.lit(n))
        b = b.withColumn("_fits", fits)
        some = b.agg(F.coalesce(F.max("_fits"), F.lit(False)).alias("_some"))  # one row
        b = b.join(F.broadcast(some), (F.col("_fits") | ~F.col("_some")), "inner").drop("_fits", "_some")
    b = b.where(F.size(C.available(F.col("formats"))) > 0)
    keys = [C.relevance(F.col("title"), F.lit(title)).alias("_r"), C.url_of(F.col("formats"), "epub").isNull().cast("int").alias("_e")]
    top = b.select("*", *keys).orderBy(F.desc("_r"), "_e", F.desc("download_count"), "ord").limit(limit)
    order = Window.orderBy(F.desc("_r"), "_e", F.desc("download_count"), "ord")  # over at most ``limit`` rows
    return top.select(F.row_number().over(order).alias("rank"), *[F.col(c) for c in books.columns])


def filter_voices(voices: DataFrame, language: str = "", gender: str = "") -> DataFrame:
    out = voices.where(F.col("language") == language) if language else voices
    return out.where(F.lower("gender") == gender.lower()) if gender else out


def find_voices(lines: DataFrame, *needles: str) -> DataFrame:
    """Voices by substrings of their catalogue line, wherever they are."""
    for n in needles:
        lines = lines.where(F.contains("line", F.lit(n))) if n else lines
    return lines


def voice_order(voices: DataFrame) -> DataFrame:
    return voices.orderBy("language", "locale", F.lower("name"))


def all_voices(catalogues: list[DataFrame], engines: DataFrame) -> DataFrame:
    """Voices of the available engines (engine, available)."""
    out = catalogues[0]
    for other in catalogues[1:]:
        out = out.unionByName(other)
    return out.join(engines.where("available").select("engine"), "engine", "left_semi")


def voices_of_prefix(ids: DataFrame) -> DataFrame:
    """Voice ids whose first letter is the language and second the gender: the columns of VOICES."""
    first, second = F.substring("id", 1, 1), F.substring("id", 2, 1)
    language, locale = F.lit(""), F.lit("")
    for letter, (lang, place) in C.LANGUAGE_OF_PREFIX.items():
        language, locale = F.when(first == letter, lang).otherwise(language), F.when(first == letter, place).otherwise(locale)
    given = F.initcap(F.when(F.instr("id", "_") > 0, F.expr("substring(id, instr(id, '_') + 1)")).otherwise(""))
    gender = F.when(second == "f", "Female").when(second == "m", "Male").otherwise("")
    return ids.select("id", F.lit("mlx").alias("engine"), F.when(given != "", given).otherwise(F.col("id")).alias("name"), language.alias("language"), locale.alias("locale"), gender.alias("gender"), F.lit("Kokoro").alias("tags"))


def queue(jobs: DataFrame) -> DataFrame:
    """Jobs (seq, name, output_path) with place in the queue and whether the output is claimed earlier."""
    same = Window.partitionBy("output_path").orderBy("seq")
    return jobs.withColumn("claimed", F.row_number().over(same) > 1)


def resolved_engines(names: DataFrame) -> DataFrame:
    return names.withColumn("engine", C.engine_name(F.col("name"))).withColumn("unknown", F.col("engine").isNull() & (strip(F.col("name")) != ""))
