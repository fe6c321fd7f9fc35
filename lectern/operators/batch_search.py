"""Many title searches at once, over an inverted index of the catalogue.

What decides between books of equal relevance doesn't depend on the query (epub first, downloads,
order of the catalogue), so books are numbered by it once: their place. The index has a row per word
and book with the book's place and its rank among the word's books by place. A query's best ``k``
then need no scan and no pairing of queries with books:

- of books that hold some of the words, the best ``k`` are among the first ``k`` of each word, for
  whatever precedes a book in a word's list is at least as relevant;
- books that hold all words are in the list of the rarest; it is read in growing pieces, and only
  for queries that haven't found ``k`` yet;
- books that hold none are only wanted where fewer than ``k`` hold some, and then the first ``k``
  books of all suffice.

Queries of the same words are answered once. A word's list is numbered across tasks, however many
books hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import catalog as C
from lectern.functions.text import tokens
from lectern.shared import free, kept_once, numbered

#: Books of the rarest word that are looked at first; four times as many in each further round.
FIRST_PIECE = 1024


@dataclass
class Index:
    """books: place and the catalogue's columns; words: word, place, nth (from 1), words of the book; sizes: word, books."""

    books: DataFrame
    words: DataFrame
    sizes: DataFrame
    place: str


def built(books: DataFrame) -> Index:
    """The index of ``books`` (as ``catalog.search`` takes them); books without a format are left out."""
    place, plain, fewer = (free(books, c) for c in ("place", "plain", "fewer"))
    some = books.where(F.size(C.available(F.col("formats"))) > 0)
    keyed = some.withColumns({plain: C.url_of(F.col("formats"), "epub").isNull(), fewer: -F.col("download_count")})
    own = numbered(keyed, plain, fewer, "ord", name=place).drop(plain, fewer)
    held = own.select(F.col(place).alias("place"), F.array_distinct(tokens(F.col("title"))).alias("held"))
    listed = numbered(held.select(F.explode("held").alias("word"), "place", "held"), "word", "place", name="n")
    sizes = kept_once(listed.groupBy("word").agg(F.min("n").alias("first"), F.count("*").alias("books")))
    words = listed.join(sizes.select("word", "first"), "word").select("word", "place", (F.col("n") - F.col("first") + 1).alias("nth"), "held")
    return Index(own, kept_once(words), sizes.select("word", "books"), place)


def _all(wanted: str, held: str) -> Column:
    return F.size(F.array_except(wanted, held)) == 0


def searched(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` books for each of ``queries`` (its columns, of which ``title``): those columns, rank, relevance, and the books' columns as ``book``."""
    key, wanted = free(queries, "key"), F.array_sort(F.array_distinct(tokens(F.col("title"))))
    asked = queries.withColumn(key, F.array_join(wanted, " "))
    sets = kept_once(asked.select(F.col(key).alias("key")).distinct().withColumn("wanted", F.filter(F.split("key", " "), lambda w: w != "")))
    each = sets.select("key", "wanted", F.explode("wanted").alias("word")).join(index.sizes, "word", "left").withColumn("books", F.coalesce("books", F.lit(0)))
    some = each.join(index.words.where(F.col("nth") <= k), "word").select("key", "place", F.when(_all("wanted", "held"), 2).otherwise(1).alias("relevance"))
    found = kept_once(some.unionByName(_holding_all(index, each, k)).distinct())
    few = sets.select("key").join(found.groupBy("key").agg(F.count("*").alias("n")), "key", "left").where(F.coalesce("n", F.lit(0)) < k)
    first = few.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("place"))
    none = first.join(found, ["key", "place"], "left_anti").withColumn("relevance", F.lit(0))
    best = Window.partitionBy("key").orderBy(F.desc("relevance"), "place")
    ranked = found.unionByName(none).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    book = index.books.select(F.col(index.place).alias("place"), F.struct(*[c for c in index.books.columns if c != index.place]).alias("book"))
    told = ranked.join(book, "place").drop("place")
    return asked.join(told.withColumnRenamed("key", key), key).drop(key)


def _holding_all(index: Index, each: DataFrame, k: int) -> DataFrame:
    """(key, place, relevance) of books that hold all words of a query: the first ``k`` at least, if there are."""
    rarest = each.groupBy("key").agg(F.min_by(F.struct("word", "books", "wanted"), F.struct("books", "word")).alias("w")).select("key", "w.*")
    open_ = kept_once(rarest.where("books > 0"))
    found, low, high = None, 0, max(FIRST_PIECE, k)
    while not open_.isEmpty():
        piece = index.words.where(F.col("nth").between(low + 1, high))
        hit = open_.join(piece, "word").where(_all("wanted", "held")).select("key", "place", F.lit(2).alias("relevance"))
        found = kept_once(hit if found is None else found.unionByName(hit))
        n = found.groupBy("key").agg(F.count("*").alias("n"))
        low, high = high, 4 * high
        open_ = kept_once(open_.where(F.col("books") > low).join(n, "key", "left").where(F.coalesce("n", F.lit(0)) < k).select(*open_.columns))
    return open_.select("key", F.lit(0).cast("long").alias("place"), F.lit(2).alias("relevance")) if found is None else found
