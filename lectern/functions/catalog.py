"""Catalogue records: authors, relevance, formats, voices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip, tokens

# Format preferences, epithets, aliases, voice prefixes.
FORMATS = {
    "epub": ("application/epub+zip",),
    "text": ("text/plain; charset=utf-8", "text/plain; charset=us-ascii", "text/plain"),
    "html": ("text/html",),
    "cover": ("image/jpeg", "image/png"),
}
EPITHETS = (
    "of", "the", "and", "emperor", "empress", "king", "queen", "prince", "princess", "saint", "st", "sir", "dame", "lord", "lady", "pope",
    "bishop", "captain", "president", "dr", "mrs", "mr", "ms", "baron", "count", "countess", "duke", "pseud", "jr", "sr", "active", "approximately",
)
ENGINES = ("edge", "gemini", "google-cloud", "mlx")
ALIASES = {"google": "google-cloud", "cloud": "google-cloud", "gcp": "google-cloud", "local": "mlx", "kokoro": "mlx", "mlx-audio": "mlx", "edge-tts": "edge"}
LANGUAGE_OF_PREFIX = {"a": ("en", "US"), "b": ("en", "GB"), "e": ("es", ""), "f": ("fr", ""), "h": ("hi", ""), "i": ("it", ""), "j": ("ja", ""), "p": ("pt", "BR"), "z": ("zh", "")}
MAX_CHARS = {"edge": 8000, "gemini": 6000, "google-cloud": 4000, "mlx": 4000}


def author_name(name: Column) -> Column:
    """"Surname, Given" turned round if the part after the only comma looks like given names."""
    name = strip(F.coalesce(name, F.lit("")))
    tail = strip(F.substring_index(name, ",", -1))
    given = F.filter(F.split(tail, r"(?U)\s+", -1), lambda t: t != "")
    epithet = F.exists(given, lambda t: F.lower(F.regexp_replace(t, r"\A\.+|\.+\z", "")).isin(*EPITHETS))
    turned = strip(F.concat(tail, F.lit(" "), strip(F.substring_index(name, ",", 1))))
    one = F.length(name) - F.length(F.replace(name, F.lit(","), F.lit(""))) == 1
    return F.when(one & F.size(given).between(1, 2) & ~epithet, turned).otherwise(name)


def relevance(title: Column, query: Column) -> Column:
    """2: every word of the query is in the title, 1: some, 0: none or no query."""
    wanted, have = tokens(query), tokens(title)
    found = F.size(F.filter(wanted, lambda t: F.array_contains(have, t)))
    return F.when(F.size(wanted) == 0, 0).when(found == F.size(wanted), 2).when(found > 0, 1).otherwise(0)


def url_of(formats: Column, kind: str) -> Column:
    """The first url, by preferred type, then in the record's order, that is no zip. formats: array of (mime, url)."""
    return F.get(F.concat(*[_matching(formats, wanted) for wanted in FORMATS[kind]]), F.lit(0))["url"]


def _matching(formats: Column, wanted: str) -> Column:
    return F.filter(formats, lambda f: f["mime"].startswith(wanted) & ~f["url"].endswith(".zip"))


def available(formats: Column) -> Column:
    return F.filter(F.array(*[F.when(url_of(formats, k).isNotNull(), F.lit(k)) for k in ("epub", "text", "html")]), lambda k: k.isNotNull())


def engine_name(name: Column) -> Column:
    """A speech engine by name or alias; null if there is none."""
    key = F.lower(strip(name))
    known = F.create_map(*[F.lit(x) for pair in (ALIASES | {e: e for e in ENGINES}).items() for x in pair])
    return F.try_element_at(known, key)


def voice_display(name: Column, locale: Column, gender: Column, tags: Column) -> Column:
    some = lambda c, text: F.when(c != "", text)
    return F.concat_ws(" ", name, some(locale, F.concat(F.lit("("), locale, F.lit(")"))), some(gender, F.concat(F.lit("— "), gender)), some(tags, F.concat(F.lit("· "), tags)))
