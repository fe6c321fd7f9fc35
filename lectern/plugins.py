"""Where outside code plugs in: extractors, rewriting models, speech engines."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lectern.operators.blocks import markdown_blocks, parsed_blocks, sparse
from lectern.schema import VOICES

SEGMENT = "doc_id long, idx int, path string, size long, duration_ms long, error string"


class Engine(Protocol):
    """Speaks one text: (path, size, duration_ms).

    It also tells what it can: whether it runs here, with which voices (rows of VOICES) and which of
    them it takes if none is named, and how long a text may be. ``local`` and ``profile`` are
    optional (see ``plans.ledger``).
    """

    name: str
    concurrency: int
    max_chars: int
    default_voice: str

    def is_available(self) -> tuple[bool, str]: ...

    def voices(self) -> list[tuple]: ...

    def synthesize(self, text: str, name: str) -> tuple[str, int, int]: ...


class SilentEngine:
    """Plans without sound: a fixed pace, no files."""

    name, concurrency, max_chars, default_voice = "silent", 4, 4000, "none"

    def __init__(self, ms_per_char: int = 60):
        self.ms_per_char = ms_per_char

    def is_available(self) -> tuple[bool, str]:
        return True, ""

    def voices(self) -> list[tuple]:
        return [("none", self.name, "None", "", "", "", "")]

    def synthesize(self, text: str, name: str) -> tuple[str, int, int]:
        return f"{name}.wav", len(text), max(1, len(text) * self.ms_per_char)


def extracted(docs: DataFrame, extractor: Callable[[object], list[tuple[str, str, int]]]) -> DataFrame:
    """Blocks of documents by a function of their content: (kind, text, level) in order."""
    return parsed_blocks(docs, extractor)


def voices_of(spark: SparkSession, engines: list[Engine]) -> DataFrame:
    """The voices of the engines that can run, as VOICES; one whose list fails has none."""
    rows: list[tuple] = []
    for engine in engines:
        with contextlib.suppress(Exception):
            rows += engine.voices() if engine.is_available()[0] else []
    return spark.createDataFrame(rows, VOICES)


def limit_of(engine: Engine, asked: int) -> int:
    """How long an utterance may be: as asked, within what the engine takes."""
    return min(asked, getattr(engine, "max_chars", None) or asked)


def register_extractor(spark: SparkSession, name: str, extractor: Callable[..., Iterable[tuple]], returns: str = "kind string, text string, level int") -> None:
    """Makes an extractor a table function of SQL: a row (place, then ``returns``) per item, in order.

    ``extractor(content, ...)`` may take more arguments than the content. Its columns are told by
    ``returns``, or by its own ``returns(arguments)`` (a StructType) if it has one, which is asked
    with the types and constant values of a call. What it raises is a row without values whose
    ``error`` says so.
    """
    usual = StructType.fromDDL(returns)

    def columns(arguments: tuple[AnalyzeArgument, ...]) -> StructType:
        own = extractor.returns(arguments) if hasattr(extractor, "returns") else usual
        return StructType([StructField("place", IntegerType()), *own.fields, StructField("error", StringType())])

    class Extractor:
        def __init__(self, told: AnalyzeResult):
            self.width = len(told.schema.fields)

        @staticmethod
        def analyze(*arguments: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(schema=columns(arguments))

        def eval(self, *arguments: object) -> Iterator[tuple]:
            try:
                for place, item in enumerate(extractor(*arguments)):
                    yield (place, *item, None)
            except Exception as error:  # a document's fault is data
                yield (*(None,) * (self.width - 1), f"{type(error).__name__}: {error}")

    spark.udtf.register(name, udtf(Extractor))


def escalated(blocks: DataFrame, docs: DataFrame, converter: Callable[[object], str | None], least: int = 200) -> DataFrame:
    """Blocks with those of sparse documents (few spoken characters a page) read again.

    The converter makes Markdown of a document's content (docs: doc_id, content), which is read like
    any other. A document that it can't convert, or makes nothing of, keeps the blocks it had.
    """

    @F.pandas_udf("string")
    def converted(contents: pd.Series) -> pd.Series:
        def one(content: object) -> str | None:
            with contextlib.suppress(Exception):  # the document keeps what it has
                return converter(content)
            return None

        return contents.map(one).astype(object)

    poor = sparse(blocks, least).where("escalate").select("doc_id")
    again = docs.join(poor, "doc_id").select("doc_id", converted("content").alias("text"))
    new = markdown_blocks(again)
    return blocks.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new.select(*blocks.columns))


def candidates(text: Column, model: Callable[[str], str | None]) -> Column:
    """A model's rewrites (struct candidate, failed), in Arrow batches.

    A model with a method ``rewrite_all`` gets a batch of texts at once and returns as many rewrites;
    if that raises, or for other models, texts go one by one and only those that raise have failed.
    """

    @F.pandas_udf("candidate string, failed boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = None
        if hasattr(model, "rewrite_all"):
            try:
                found = list(model.rewrite_all(texts.tolist()))
                rows = [(x, False) for x in found] if len(found) == len(texts) else None
            except Exception:  # one text's fault is not the batch's
                rows = None
        if rows is None:
            rows = []
            for t in texts:
                try:
                    rows.append((model(t), False))
                except Exception:  # whatever the model raises is a failed candidate
                    rows.append((None, True))
        return pd.DataFrame(rows, columns=["candidate", "failed"])

    return run(text)


def require(name: str, plugin: object) -> None:
    """Raises before any work if a plug-in says that it can't run (method ``is_available``: (ok, reason))."""
    ok, reason = plugin.is_available() if hasattr(plugin, "is_available") else (True, "")
    if not ok:
        raise RuntimeError(f"{name} is not available: {reason}")


def states(plugins: dict[str, Callable[[], object]]) -> list[tuple[str, bool, str]]:
    """(name, available, reason) of plug-ins by their makers, as ``library.availability`` takes them; what can't be made is left out."""
    out = []
    for name, make in plugins.items():
        try:
            plugin = make()
        except Exception:  # a broken optional import shouldn't hide the rest
            continue
        ok, reason = plugin.is_available() if hasattr(plugin, "is_available") else (True, "")
        out.append((name, ok, reason))
    return out


def page_texts(pages: DataFrame, layout: Callable | None = None, plain: Callable | None = None, ocr: Callable | None = None) -> DataFrame:
    """Pages (doc_id, page, content) through up to three readers of a page's content, as ``pages.tiers`` takes them.

    A layout reader returns Markdown, the others text. OCR's failures are told; others give null.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, page, content in zip(part["doc_id"], part["page"], part["content"]):
                texts: list[str | None] = []
                error = None
                for reader in (layout, plain, ocr):
                    try:
                        texts.append(reader(content) if reader else None)
                    except Exception as failed:  # a reader's failure is data
                        texts.append(None)
                        error = str(failed) if reader is ocr else error
                rows.append((doc_id, page, *texts, error))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "layout", "plain", "ocr", "ocr_error"])

    return pages.select("doc_id", "page", "content").mapInPandas(run, "doc_id long, page int, layout string, plain string, ocr string, ocr_error string")


def synthesized(utterances: DataFrame, engine: Engine, attempts: int = 3, backoff_s: float = 2.0) -> DataFrame:
    """Segments of utterances (doc_id, idx, text) in as many tasks as the engine takes at once.

    All are tried; what fails after ``attempts`` keeps its message. A text whose file the engine has
    already (method ``existing``, returning as ``synthesize`` does, or null) isn't spoken again, so
    a task that is run again after a loss goes on where the first one ended.
    """
    existing = getattr(engine, "existing", None) or (lambda text, name: None)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, idx, text in zip(part["doc_id"], part["idx"], part["text"]):
                for attempt in range(1, attempts + 1):
                    try:
                        name = f"{doc_id}/chunk_{idx:05d}"
                        rows.append((doc_id, idx, *(existing(text, name) or engine.synthesize(text, name)), None))
                        break
                    except Exception as error:  # an engine's failure is data
                        if attempt == attempts:
                            rows.append((doc_id, idx, None, 0, 0, str(error)))
                        else:
                            time.sleep(backoff_s * 2 ** (attempt - 1))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "path", "size", "duration_ms", "error"])

    return utterances.select("doc_id", "idx", "text").repartition(engine.concurrency).mapInPandas(run, SEGMENT)
