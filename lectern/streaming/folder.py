"""New files of a folder to utterances, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.plans.narration import script_of, titles_of
from lectern.sources import files

FILE = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends the utterances of files as they arrive to the table at ``out``; every batch is one
    folder named by its number, so a batch that is done again replaces itself."""
    stream = spark.readStream.format("binaryFile").schema(FILE).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        docs = rows.select(F.xxhash64("path").alias("doc_id"), "path", files.reader_of(F.col("path")).alias("reader"), "content")
        blocks = files.blocks(docs)
        script_of(blocks, titles_of(docs, blocks), **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
