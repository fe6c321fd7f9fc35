"""One file per row, all of them or none.

The format ``lectern_files`` writes rows (path, content) as files below a folder. Tasks write to a
folder of the job's own inside the target, each attempt to its own part of it, with a list of what
they wrote; the driver learns only where the lists are. When all tasks have ended, the lists are
read, two rows for one path or a file that is there already (unless the mode is ``overwrite``) are
errors, and only then files are moved to their places. What a failed job or a lost attempt wrote is
removed with the job's folder. A path is taken below the folder, whatever it begins with; one that
leaves it is an error, as is a null path. A null content is an empty file.
"""

from __future__ import annotations

import contextlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, Row, StringType, StructType

from lectern.shared import filesystem, kept_once

#: Files moved at once when a job is committed.
MOVERS = 16


def below(path: str | None) -> str:
    """A path relative to the folder, checked."""
    if path is None:
        raise ValueError("a file without path")
    at = posixpath.normpath(path.lstrip("/"))
    if at in ("", ".") or at.startswith("..") or "\x00" in at:
        raise ValueError(f"no path of a file below the folder: {path!r}")
    return at


@dataclass
class Written(WriterCommitMessage):
    """Where the list of a task's files is."""

    listed: str


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex
        fs, at = filesystem(folder)  # on the driver, before any task
        fs.create_dir(self._own(at), recursive=True)
        with fs.open_output_stream(f"{self._own(at)}/open"):
            pass

    def _own(self, at: str) -> str:
        return f"{at}/_writing-{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        fs, at = filesystem(self.folder)
        mine, names = f"{self._own(at)}/{uuid.uuid4().hex}", []
        going = lambda: fs.get_file_info(f"{self._own(at)}/open").is_file
        try:
            if going():
                fs.create_dir(mine, recursive=False)
            for k, row in enumerate(rows):
                names.append(below(row["path"]))
                content = row["content"] if row["content"] is not None else b""
                with fs.open_output_stream(f"{mine}/{k}") as file:
                    file.write(content.encode() if isinstance(content, str) else bytes(content))
            with fs.open_output_stream(f"{mine}/list") as file:
                file.write(json.dumps(names).encode())
            if not going():  # the job failed meanwhile
                raise RuntimeError("the job was given up")
        except BaseException:
            self._removed(fs, mine)
            raise
        return Written(mine)

    @staticmethod
    def _removed(fs: pafs.FileSystem, folder: str) -> None:
        """Removes a folder that other tasks may still write to: what they make meanwhile goes with the next try, or by themselves."""
        for _ in range(5):
            if fs.get_file_info(folder).type.name != "Directory":
                return
            with contextlib.suppress(OSError):
                fs.delete_dir(folder)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = filesystem(self.folder)
        try:
            moves: dict[str, str] = {}
            for m in messages:
                if m is None:
                    continue
                with fs.open_input_stream(f"{m.listed}/list") as file:
                    for k, name in enumerate(json.loads(file.read())):
                        if name in moves:
                            raise ValueError(f"two rows for one file: {name}")
                        moves[name] = f"{m.listed}/{k}"
            if not self.overwrite:
                there = [n for n, info in zip(moves, fs.get_file_info([f"{at}/{n}" for n in moves])) if info.type.name != "NotFound"]
                if there:
                    raise FileExistsError(f"{len(there)} files are there already, such as {there[0]}")
            for folder in sorted({posixpath.dirname(f"{at}/{n}") for n in moves}):
                fs.create_dir(folder, recursive=True)
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(lambda n: fs.move(moves[n], f"{at}/{n}"), moves))
        finally:
            self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = filesystem(self.folder)
        with contextlib.suppress(OSError):
            fs.delete_file(f"{self._own(at)}/open")  # tasks that still run then give up
        self._removed(fs, self._own(at))


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        kinds = {f.name: f.dataType for f in schema.fields}
        if not isinstance(kinds.get("path"), StringType) or not isinstance(kinds.get("content"), StringType | BinaryType):
            raise ValueError("rows must have a path (string) and a content (string or binary)")
        return FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Files (path, content) below ``folder``: all of them, or none and an error."""
    register(files.sparkSession)
    files.select("path", "content").write.format("lectern_files").mode("overwrite" if overwrite else "append").save(folder)


def write_per_document(rows: DataFrame, column: str, suffix: str, folder: str, overwrite: bool = False) -> None:
    """A text column (subtitles, metadata, a manifest) as one file per document, named by doc_id."""
    write_files(rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), F.col(column).alias("content")), folder, overwrite)


def removed(names: DataFrame, folder: str) -> DataFrame:
    """Removes the folders below ``folder`` that ``names`` (doc_id) name, such as those of segments: doc_id, removed, error.

    One that isn't there is none to remove, so it may be done again; what can't be removed is told.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = filesystem(folder)
        for part in parts:
            rows = []
            for doc_id in part["doc_id"].tolist():
                try:
                    own = f"{at}/{below(str(doc_id))}"
                    there = fs.get_file_info(own).type.name == "Directory"
                    if there:
                        fs.delete_dir(own)
                    rows.append((doc_id, there, None))
                except (OSError, ValueError) as error:
                    rows.append((doc_id, False, str(error)))
            yield pd.DataFrame(rows, columns=["doc_id", "removed", "error"])

    kind = names.schema["doc_id"].dataType.simpleString()
    return kept_once(names.where("doc_id is not null").select("doc_id").distinct().mapInPandas(run, f"doc_id {kind}, removed boolean, error string"))
