"""Catalogues and books behind addresses: requests made natively, answers fetched with retries, downloads kept together.

What fetches is a plug-in (``Fetcher``), so that a run without network can read a mirror. An address
is asked for once, however many rows name it, by as many tasks as the service bears
(``concurrency``); answers are written to the shared folder, so reading them again asks nobody. What
the network raises (``OSError``) is tried again after a delay that grows linearly; what still fails,
or fails otherwise, is a row with its error, never the run's end.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.shared import filesystem, free, kept_once
from lectern.sources.files import BOOK, book_records
from lectern.sources.sink import below, write_files

ANSWER = "url string, content binary, attempts int, error string"
_ANSWER = pa.schema([("url", pa.string()), ("content", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])


class Fetcher(Protocol):
    """Gets what is at an address; raises ``OSError`` where another try may help."""

    concurrency: int

    def get(self, url: str) -> bytes: ...


class HttpFetcher:
    def __init__(self, agent: str, timeout_s: float = 30, concurrency: int = 4):
        self.agent, self.timeout_s, self.concurrency = agent, timeout_s, concurrency

    def get(self, url: str) -> bytes:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout_s) as answer:
            return answer.read()


class Mirror:
    """Answers from files below a folder: host, path and, if there is one, ``?`` and the query as asked."""

    def __init__(self, folder: str, concurrency: int = 16):
        self.folder, self.concurrency = folder.rstrip("/"), concurrency

    def get(self, url: str) -> bytes:
        parts = urlsplit(url)
        name = below(f"{parts.netloc}{unquote(parts.path)}" + (f"?{parts.query}" if parts.query else ""))
        fs, at = filesystem(f"{self.folder}/{name}")
        with fs.open_input_stream(at, compression=None) as file:
            return file.read()


# -- requests ----------------------------------------------------------------------------------


def quoted(value: Column) -> Column:
    """A value as forms quote it: letters, digits and ``_.-~`` as they are, a blank as a plus."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def request(base: str, **params: Column) -> Column:
    """The address of a request; parameters that are null or empty are left out."""
    given = [F.when(v != "", F.concat(F.lit(f"{k}="), quoted(v))) for k, v in params.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *given))


def search_request(base: str, title: Column, author: Column, language: Column) -> Column:
    """The address that asks for a title, an author or both; null if neither says anything."""
    some = lambda c: F.when(T.strip(c) != "", c)
    terms = F.concat_ws(" ", some(title), some(author))
    return F.when(terms != "", request(base, search=terms, languages=language))


# -- answers -----------------------------------------------------------------------------------


def fetched(urls: DataFrame, fetcher: Fetcher, attempts: int = 3, delay_s: float = 2.0) -> DataFrame:
    """What is at each address of ``urls`` (url): one row ANSWER per address; null addresses are passed over.

    The n-th failure is followed by a wait of n times ``delay_s``.
    """

    def tried(url: str) -> tuple[bytes | None, int, str | None]:
        for attempt in range(1, attempts + 1):
            try:
                return fetcher.get(url), attempt, None
            except Exception as failed:  # an address that fails is data
                if attempt == attempts or not isinstance(failed, OSError):
                    return None, attempt, f"could not reach {url}: {failed}"
            time.sleep(delay_s * attempt)
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                content, n, error = tried(url)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((url, content, n, error), _ANSWER)], schema=_ANSWER)

    asked = urls.where("url is not null").select("url").distinct().repartition(fetcher.concurrency, "url")
    return kept_once(asked.mapInArrow(run, ANSWER))


def answered(wanted: DataFrame, fetcher: Fetcher, attempts: int = 3, delay_s: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Catalogue searches (``wanted``: url, and columns that no book record has): (books, errors).

    Books are the records of the answers, as ``files.catalogue`` gives them, beside the columns of
    ``wanted``; ``ord`` is a record's place in its answer. Errors are the rows of ``wanted`` whose
    answer didn't come, or is no JSON, and why.
    """
    content, failed, body, place, item = (free(wanted, n) for n in ("content", "error", "body", "place", "item"))
    got = fetched(wanted, fetcher, attempts, delay_s).select("url", F.col("content").alias(content), F.col("error").alias(failed))
    text = F.make_valid_utf8(F.col(content).cast("string"))
    foreign = F.col(content).isNotNull() & F.try_parse_json(text).isNull()
    rows = wanted.join(got, "url").withColumn(failed, F.coalesce(failed, F.when(foreign, F.concat("url", F.lit(" answered with something that is no JSON")))))
    found = rows.where(F.col(failed).isNull()).withColumn(body, F.from_json(text, f"results array<struct<{BOOK}>>"))
    items = found.select(*wanted.columns, F.posexplode(f"{body}.results").alias(place, item)).where(F.col(item).isNotNull())
    books = book_records(items.select(*wanted.columns, F.col(place).cast("long").alias(place), f"{item}.*"), F.col(place), wanted.columns)
    return books, rows.where(F.col(failed).isNotNull()).select(*wanted.columns, F.col(failed).alias("error"))


def downloaded(plan: DataFrame, fetcher: Fetcher, folder: str, attempts: int = 3, delay_s: float = 2.0) -> DataFrame:
    """Fetches what a plan (``operators.library.downloads`` into ``folder``) lacks: its rows with size (of what was fetched) and error.

    Files are put into place together when all were asked for; what can't be fetched, or is empty, is
    no file and says why. Copies that were empty are replaced.
    """
    answers = fetched(plan.where("not hit and error is null"), fetcher, attempts, delay_s)
    got = answers.select("url", "content", F.coalesce("error", F.when(F.octet_length("content") == 0, F.concat(F.lit("nothing is at "), "url"))).alias("failed"))
    new = plan.where("not hit and error is null").join(got, "url")
    write_files(new.where("failed is null").select(F.substr("path", F.lit(len(folder.rstrip("/")) + 2)).alias("path"), "content").dropDuplicates(["path"]), folder, overwrite=True)
    told = got.select("url", F.octet_length("content").cast("long").alias("size"), "failed")
    fresh = ~F.col("hit") & F.col("failed").isNull()
    return plan.join(told, "url", "left").select(*[c for c in plan.columns if c != "error"], F.when(fresh, F.col("size")).alias("size"), F.coalesce("error", F.when(~F.col("hit"), F.col("failed"))).alias("error"))
