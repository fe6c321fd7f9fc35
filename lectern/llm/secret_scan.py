r"""Secret scans with rules and character Markov models, from DataFrame functions only.

Base rules find assignments, access keys and hexadecimal strings. The method adds spans of kind
``markov``: runs of ``A-Z a-z 0-9 + / _ = -``, cut at base spans into stretches of which those of 20
and more signs count, that a character Markov model of random strings explains better than one of
ordinary identifiers: the log-likelihood ratio of their first-order transitions exceeds
``THRESHOLD`` nats.

Both models are trained from labelled samples, a table (token, random). ``labelled_samples`` makes
one: random strings in hexadecimal and base-64 from SHA-256 digests, and identifiers (plain,
snake_case, camelCase, kebab-case) from the words of at most ``SAMPLE_DOCS`` documents, those of
smallest hash of their id; a table of one's own may be given instead. Training counts transitions
in Spark; what reaches the driver is one number per pair of characters.

Spark has no function for the places of all matches. They follow from what a text is split into:
``regexp_extract_all`` gives the matches, ``split`` by the same pattern the text between them, and
running sums of their lengths the places. Running sums and maxima are taken block by block (an
array of n in blocks of its root), runs are scored character by character in pieces of bounded
size, and what stands between spans is cut out of a copy of the text in four bytes per character:
no step's work is the square of a text's length, of a run's or of the number of matches. Texts
without a match are told by one ``rlike``.

Behaviour at the edges: a null text counts as empty and has no spans; offsets are code points, end
exclusive; spans of different base kinds may overlap and are all kept; a null doc_id stays null;
repeated rows each have their result; other columns are ignored; an empty table gives an empty
result, and with no documents to take identifiers from, none are learned and every transition of
an identifier is equally likely.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.arrays import let, running
from lectern.llm.common import unused

#: Fixed patterns of the base rules.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A key or hexadecimal run too short for its rule ends with its run, so the least length can stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST_VALUE, LEAST_RUN = 6, 20
KINDS = ("assign", "access", "hex", "markov")
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_DOCS, RANDOM_STRINGS = 1000, 4000
#: Tasks that the sampled documents are dealt out to: few bytes, so Spark would give them to one or two.
SAMPLE_TASKS = 32
THRESHOLD, SMOOTHING = 8.0, 0.5
SPAN, SPAN_OF_TEXT = "struct<start:int,rank:int,end:int>", "struct<start:int,rank:int,end:int,m:string>"
#: Characters of a run that are scored at once.
PIECE = 1 << 16
REDACTED = "[SECRET]"


def places(text: Column, pattern: str, rank: int, value_group: int = 0, least: int = 0, with_text: bool = False) -> Column:
    """Spans (array of struct start, rank, end) of the matches whose value group has ``least`` code points.

    With ``with_text``, structs hold the match too, as ``m``.
    """
    found = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kind = f"array<{SPAN_OF_TEXT if with_text else SPAN}>"

    def of(matches: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        return let(sizes, lambda z: spans(z, matches, running(F.transform(z, lambda x: x["g"] + x["m"]), lambda a, b: a + b)))

    def spans(sizes: Column, matches: Column, before: Column) -> Column:
        values = F.transform(found(value_group), F.length) if least else F.transform(matches, lambda m: F.lit(0))
        rows = F.arrays_zip(sizes.alias("z"), before.alias("at"), values.alias("v"), matches.alias("m"))
        if least:
            rows = F.filter(rows, lambda r: r["v"] >= least)

        def span(r: Column) -> Column:
            start = r["at"] + r["z"]["g"]
            own = [start.alias("start"), F.lit(rank).alias("rank"), (start + r["z"]["m"]).alias("end")]
            return F.struct(*own, r["m"].alias("m")) if with_text else F.struct(*own)

        return F.transform(rows, span)

    return F.when(text.rlike(pattern), let(found(0), of).cast(kind)).otherwise(F.array().cast(kind))


def between(text: Column, spans: Column, told: Callable[[Column, Column], Column]) -> Column:
    """``text`` with each of its spans (by start, at least one) replaced by ``told(span, reached)``,
    reached being the end of all spans before it; what no span covers stays."""
    wide = F.encode(text, "UTF-32")  # four bytes per code point, so that cutting need not count from the start
    mark = F.encode(F.lit("\ufeff"), "UTF-32")  # decoding takes one off the front, so each slice gets one that isn't the text's
    cut = lambda w, a, b: F.decode(F.concat(mark, F.substring(w, 4 * a + 1, 4 * F.greatest(b - a, F.lit(0)))), "UTF-32")

    def of(s: Column) -> Column:
        reached = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        parts = lambda w: F.zip_with(s, reached, lambda x, at: F.concat(cut(w, at, x["start"]), told(x, at)))
        return let(wide, lambda w: F.concat(F.array_join(parts(w), ""), cut(w, F.array_max(F.transform(s, lambda x: x["end"])), F.length(text))))

    return let(spans, of)


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    digest = F.sha2(F.col("id").cast("string"), 256)
    size = (F.lit(24) + F.col("id") % 17).cast("int")
    raw = F.base64(F.unhex(digest))
    kinds = F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, raw).otherwise(F.translate(raw, "+/", "-_"))
    return spark.range(n).select(F.substring(kinds, F.lit(1), size).alias("token"), F.lit(True).alias("random"))


def identifiers(docs: DataFrame, n_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Ordinary identifiers from the words of at most ``n_docs`` documents."""
    hashed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("h"), "text").where("text is not null")
    last = hashed.select("h").distinct().orderBy("h").limit(n_docs).agg(F.max("h")).first()[0]  # a number
    some = hashed.where(F.col("h") <= last).repartition(SAMPLE_TASKS, "h").dropDuplicates(["h"])
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{2,}"), F.lit(0))
    pairs = some.select(words.alias("w")).where("size(w) > 1").select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    forms = F.array("a", F.concat("a", F.lit("_"), "b"), F.concat(F.lower("a"), F.initcap("b")), F.concat("a", F.lit("-"), "b"), F.concat(F.upper("a"), F.lit("_"), F.upper("b")), F.concat("a", "b"))
    return pairs.select(F.explode(forms).alias("token"), F.lit(False).alias("random"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    return random_strings(docs.sparkSession).unionByName(identifiers(docs))


def train(samples: DataFrame) -> np.ndarray:
    """Log-likelihood ratios (random over ordinary) of transitions between the characters of SIGNS."""
    steps = samples.where("length(token) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("s"))
    counts = {True: np.full((len(SIGNS),) * 2, SMOOTHING), False: np.full((len(SIGNS),) * 2, SMOOTHING)}
    place = {c: k for k, c in enumerate(SIGNS)}
    known = F.col("s").rlike(r"\A[A-Za-z0-9+/_=-]{2}\z")
    for row in steps.where(known).groupBy("random", "s").count().collect():  # a row per pair of characters and label
        counts[bool(row["random"])][place[row["s"][0]], place[row["s"][1]]] += row["count"]
    log = {k: np.log(c / c.sum(1, keepdims=True)) for k, c in counts.items()}
    return log[True] - log[False]


def ratio(token: Column, model: np.ndarray) -> Column:
    """The log-likelihood ratio of a token made of SIGNS."""
    wide = np.zeros((128, 128))
    codes = [ord(c) for c in SIGNS]
    wide[np.ix_(codes, codes)] = model
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in wide.ravel())), ",").cast("array<double>")

    def piece(text: Column) -> Column:
        codes = F.transform(F.split(text, ""), F.ascii)
        steps = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(table, a * 128 + b + 1))
        return let(codes, lambda c: F.aggregate(steps(c), F.lit(0.0), lambda acc, x: acc + x))

    # pieces share a sign, so that each transition is in one
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(token) - 2, F.lit(0)) / PIECE).cast("int"))
    return F.aggregate(F.transform(starts, lambda k: piece(F.substring(token, k * PIECE + 1, F.lit(PIECE + 1)))), F.lit(0.0), lambda acc, x: acc + x)


def located(docs: DataFrame, model: np.ndarray, base: str, spans: str, text: str = "text") -> DataFrame:
    """``docs`` with two more columns, named ``base`` and ``spans``: the base spans and all spans, by start, then kind."""
    whole = F.coalesce(docs[text], F.lit(""))
    out = docs.withColumn(base, F.array_sort(F.concat(places(whole, ASSIGN, 0, 1, LEAST_VALUE), places(whole, ACCESS, 1), places(whole, HEX, 2))))
    # what base spans leave of the runs are the runs of the text with base spans blanked out
    blank = lambda s, reached: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], reached), F.lit(0)))
    masked = F.when((F.size(base) > 0) & whole.rlike(RUN), between(whole, F.col(base), blank)).otherwise(whole)
    likely = F.filter(let(masked, lambda t: places(t, RUN, 3, with_text=True)), lambda s: ratio(s["m"], model) > THRESHOLD)
    added = F.transform(likely, lambda s: F.struct(s["start"], s["rank"], s["end"]))
    return out.withColumn(spans, F.array_sort(F.concat(base, added.cast(f"array<{SPAN}>"))))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])))


def secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, base_sha256 and spans."""
    model = train(labelled_samples(docs) if samples is None else samples)
    rows = located(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, "base", "all")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    n = [of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("doc_id", *n, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def redacted(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret replaced by REDACTED, spans that overlap by one, ``n_chars`` (if
    there) following; nothing else changes, and other columns may have any name."""
    base, spans, new = (unused(docs, c) for c in ("base", "spans", "new"))
    rows = located(docs, train(labelled_samples(docs) if samples is None else samples), base, spans)
    once = lambda s, reached: F.when(s["start"] >= reached, REDACTED).otherwise("")
    some = F.size(spans) > 0
    rows = rows.withColumn(new, F.when(some, between(rows["text"], F.col(spans), once)).otherwise(rows["text"]))
    out = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(some, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(rows["n_chars"])
    return rows.select(*[out.get(c, rows[c]).alias(c) for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
