"""A ledger of what has been spoken, by content.

The key of a text is a hash of engine, voice and text: a text that occurs often is spoken once, and
of an edited document only what changed is spoken again. What has no usable entry is dealt out and
cut into batches of a fixed size, in an order that a task run again finds again. A batch is committed
by the task that spoke it, as one file of the ledger, moved into its place when it is whole; its name
is a hash of its keys. So a task that is lost loses one batch at most: run again, it reads what is
committed and goes on. Two attempts may speak the same batch at once; one file results.

An engine says how it is to be used: ``concurrency`` is how many tasks may speak at once where it is
a service with limits; an engine that runs in the executors says ``local = True`` and gets a task per
batch, and, where it needs a device, ``profile`` (a resource profile) chooses executors that have one.
"""

from __future__ import annotations

import hashlib
import io
import time
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plugins import SEGMENT, Engine, require
from lectern.shared import filesystem

LEDGER = "key string, path string, size long, duration_ms long, error string"
_ARROW = pa.schema([("key", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("duration_ms", pa.int64()), ("error", pa.string())])
BATCH = 64


def keyed(utterances: DataFrame, engine: Engine, voice: str = "") -> DataFrame:
    """Utterances (doc_id, idx, text) with the key of what is to be spoken."""
    return utterances.select("doc_id", "idx", "text", F.sha2(F.concat_ws("\x1f", F.lit(engine.name), F.lit(voice), F.coalesce("text", F.lit(""))), 256).alias("key"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """One row per key of a ledger: a usable entry if there is one, else its last failure."""
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    rows = spark.read.schema(LEDGER).option("pathGlobFilter", "batch-*.parquet").parquet(folder)
    return rows.groupBy("key").agg(F.max_by(F.struct("path", "size", "duration_ms", "error"), F.struct(F.col("error").isNull(), "size", "path")).alias("e")).select("key", "e.*")


def _name(keys: list[str]) -> str:
    return f"batch-{hashlib.sha256(' '.join(keys).encode()).hexdigest()}.parquet"


def _commit(folder: str, rows: list[tuple]) -> None:
    fs, at = filesystem(folder)
    data, part = io.BytesIO(), f"{at}/.writing-{uuid.uuid4().hex}"
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW), data)
    with fs.open_output_stream(part) as file:
        file.write(data.getvalue())
    fs.move(part, f"{at}/{_name([r[0] for r in rows])}")


def _committed(folder: str, keys: list[str]) -> bool:
    fs, at = filesystem(folder)
    return fs.get_file_info(f"{at}/{_name(keys)}").is_file


def _spoken(engine: Engine, key: str, text: str, attempts: int, backoff_s: float) -> tuple:
    for attempt in range(1, attempts + 1):
        try:
            return (key, *engine.synthesize(text, f"{key[:2]}/{key}"), None)
        except Exception as error:  # an engine's failure is data
            if attempt == attempts:
                return key, None, 0, 0, str(error)
            time.sleep(backoff_s * 2 ** (attempt - 1))
    raise AssertionError


def outstanding(utterances: DataFrame, engine: Engine, folder: str, voice: str = "") -> DataFrame:
    """Texts (key, text), each once, without a usable entry."""
    done = entries(utterances.sparkSession, folder).where("error is null and size > 0 and duration_ms > 0")
    # of equal keys the texts are equal
    return keyed(utterances, engine, voice).groupBy("key").agg(F.first("text").alias("text")).join(done.select("key"), "key", "left_anti")


def speak(utterances: DataFrame, engine: Engine, folder: str, voice: str = "", batch: int = BATCH, attempts: int = 3, backoff_s: float = 2.0) -> DataFrame:
    """Speaks what is outstanding and returns the segments of all ``utterances`` from the ledger, as SEGMENT."""
    require(engine.name, engine)
    todo = outstanding(utterances, engine, folder, voice)
    n = todo.count()
    tasks = -(-n // batch) if getattr(engine, "local", False) else engine.concurrency

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str]] = []

        def done(all_: bool) -> Iterator[pd.DataFrame]:
            while held and (all_ or len(held) >= batch):
                own = held[:batch]
                del held[:batch]
                if not _committed(folder, [k for k, _ in own]):
                    _commit(folder, [_spoken(engine, k, t or "", attempts, backoff_s) for k, t in own])
                yield pd.DataFrame({"n": [len(own)]})

        for part in parts:
            held += zip(part["key"], part["text"])
            yield from done(False)
        yield from done(True)

    if n:
        # an order of their own, so that a task run again cuts the same batches
        dealt = todo.repartition(max(1, tasks), "key").sortWithinPartitions("key")
        dealt.mapInPandas(run, "n long", profile=getattr(engine, "profile", None)).agg(F.sum("n")).collect()  # one number
    own = keyed(utterances, engine, voice).select("doc_id", "idx", "key").join(entries(utterances.sparkSession, folder), "key")
    return own.select(*[c.split()[0] for c in SEGMENT.split(", ")])
