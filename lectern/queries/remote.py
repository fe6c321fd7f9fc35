"""Catalogue searches and downloads: parts stand for books asked for, pages for addresses, a fetcher of fixed rules for the service."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from lectern.operators import resume as R
from lectern.queries.base import duck, put_in, table
from lectern.queries.media import SEG_CTE, _resume
from lectern.sources import remote

BASE = "https://books.example.org/all"
ASKED = """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name || ' ~*+é&' END AS title, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_brand ELSE '' END AS author, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'en' END AS language FROM {part}"""
ASKED_CTE = f"""WITH a AS ({duck(ASKED)}),
t AS (SELECT *, concat_ws(' ', CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(author) <> '' THEN author END) AS terms FROM a),
r AS (SELECT *, CASE WHEN terms <> '' THEN '{BASE}?search=' || replace(url_encode(terms), '%20', '+') || CASE WHEN language <> '' THEN '&languages=' || language ELSE '' END END AS url FROM t)"""


class Shelf:
    """Answers a search for n characters with n mod 3 books, or with what is no JSON."""

    concurrency = 8

    def get(self, url: str) -> bytes:
        terms = parse_qs(urlsplit(url).query)["search"][0]
        n = len(terms)
        if n % 7 == 0:
            return b"<html>busy</html>"
        return json.dumps({"results": [{"id": 10 * n + k, "title": f" {terms} ", "authors": [{"name": "Poe, Edgar Allan"}], "download_count": k} for k in range(n % 3)]}).encode()


class Failing:
    """Fails as often as the address's length mod 5 says, then answers with the address."""

    concurrency = 8

    def __init__(self) -> None:
        self.asked: tuple[str, int] = ("", 0)

    def get(self, url: str) -> bytes:
        self.asked = (url, self.asked[1] + 1 if self.asked[0] == url else 1)
        if len(url) % 5 >= self.asked[1]:
            raise OSError(f"try {self.asked[1]}")
        return url.encode()


def _asked(spark, sf):
    a = put_in(spark, sf, ASKED)
    return a.withColumn("url", remote.search_request(BASE, F.col("title"), F.col("author"), F.col("language")))


def _answered(spark, sf):
    books, errors = remote.answered(_asked(spark, sf).select("p_partkey", "url"), Shelf())
    found = books.select("p_partkey", "ord", "id", "title", F.get("authors", F.lit(0)).alias("author"), "download_count", F.lit(None).cast("string").alias("error"))
    return found.unionByName(errors.select("p_partkey", "error"), allowMissingColumns=True)


def _fetched(spark, sf):
    got = remote.fetched(table(spark, sf, "pages").select("url"), Failing(), delay_s=0)
    return got.select("url", F.col("attempts").cast("long").alias("attempts"), F.octet_length("content").cast("long").alias("bytes"), "error")


def _releasable(spark, sf):
    complete = R.completeness(*_resume(spark, sf))
    outputs = complete.select("doc_id", (F.col("doc_id") % 3).alias("size"))
    return R.releasable(complete.withColumn("complete", F.col("n_segments") * 2 > F.col("n_utterances")), outputs)


QUERIES = {
    "search_requests": (lambda spark, sf: _asked(spark, sf).select("p_partkey", "url"), f"{ASKED_CTE} SELECT p_partkey, url FROM r"),
    "search_answers": (_answered, f"""{ASKED_CTE}, n AS (SELECT *, length(terms) AS n FROM r WHERE url IS NOT NULL)
SELECT p_partkey, k AS ord, 10 * n + k AS id, trim(terms) AS title, 'Edgar Allan Poe' AS author, k AS download_count, NULL AS error FROM n, range(2) AS g(k) WHERE n % 7 <> 0 AND k < n % 3
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, url || ' answered with something that is no JSON' FROM n WHERE n % 7 = 0"""),
    "addresses_fetched": (_fetched, """SELECT DISTINCT url, least(length(url) % 5 + 1, 3) AS attempts, CASE WHEN length(url) % 5 < 3 THEN strlen(url) END AS bytes,
CASE WHEN length(url) % 5 >= 3 THEN 'could not reach ' || url || ': try 3' END AS error FROM pages WHERE url IS NOT NULL"""),
    "segments_releasable": (_releasable, f"WITH {SEG_CTE} SELECT doc_id FROM s WHERE doc_id % 3 > 0 GROUP BY doc_id HAVING count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0) * 2 > count(*)"),
}
