"""ZIP archives (EPUBs among them) as a table with a row per entry.

The format ``lectern_archive`` lists a folder's archives with their sizes. Small ones are gathered
into partitions; of a large one only the directory at its end is read, and its entries are cut into
partitions of about ``split`` compressed bytes, so several tasks read it, each its own byte ranges.
Predicates on ``path`` (equality, lists, prefixes) leave files out before any is opened, those on
``entry`` (also suffixes) entries before any is read; ``suffixes`` does so for several suffixes.

An archive that can't be read is one row without entry, with the error; an entry that can't be read
is a row with its error and no content.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from lectern.shared import filesystem

SCHEMA = "path string, entry string, place int, size long, error string, content binary"
ARROW = pa.schema([("path", pa.string()), ("entry", pa.string()), ("place", pa.int32()), ("size", pa.int64()), ("error", pa.string()), ("content", pa.binary())])
SPLIT, BATCH = 64 << 20, 16 << 20


@dataclass
class Entries(InputPartition):
    """Whole archives, or entries ``first`` to before ``last`` of one."""

    paths: list[str] = field(default_factory=list)
    first: int = 0
    last: int | None = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.at, self.split = options["path"], int(options.get("split", SPLIT))
        self.ends = tuple(s.strip().lower() for s in options.get("archives", ".zip,.epub").split(","))
        self.suffixes = tuple(s.strip().lower() for s in options["suffixes"].split(",")) if options.get("suffixes") else None
        self.tests: dict[str, list] = {"path": [], "entry": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if len(column) == 1 and column[0] in self.tests and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | IsNotNull):
                self.tests[column[0]].append(f)
            else:
                yield f

    def _wants(self, column: str, value: str | None) -> bool:
        def holds(f: Filter) -> bool:
            if value is None:
                return False
            if isinstance(f, EqualTo | In):
                return value in (f.value if isinstance(f, In) else (f.value,))
            return isinstance(f, IsNotNull) or (value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value))

        return all(map(holds, self.tests[column]))

    def _wanted(self, info: zipfile.ZipInfo) -> bool:
        return not info.is_dir() and self._wants("entry", info.filename) and (self.suffixes is None or info.filename.lower().endswith(self.suffixes))

    def _name(self, path: str) -> str:
        """A file's path as Spark names it."""
        scheme = self.at.partition("://")[0] if "://" in self.at else "file"
        return f"file:{path}" if scheme == "file" else f"{scheme}://{path}"

    def partitions(self) -> list[Entries]:
        fs, at = filesystem(self.at)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        out, group, size = [], [], 0
        for x in sorted((x for x in found if x.is_file and x.path.lower().endswith(self.ends) and self._wants("path", self._name(x.path))), key=lambda x: x.path):
            if x.size > self.split:
                out += self._parts(fs, x.path)
                continue
            if group and size + x.size > self.split:
                out.append(Entries(group))
                group, size = [], 0
            group.append(x.path)
            size += x.size
        return out + ([Entries(group)] if group else [])

    def _parts(self, fs: pafs.FileSystem, path: str) -> list[Entries]:
        try:
            with fs.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                sizes = [x.compress_size if self._wanted(x) else 0 for x in z.infolist()]
        except Exception:  # told by the task that reads it
            return [Entries([path])]
        parts, first, size = [], 0, 0
        for k, n in enumerate(sizes):
            if size and size + n > self.split:
                parts.append(Entries([path], first, k))
                first, size = k, 0
            size += n
        return [*parts, Entries([path], first, len(sizes))]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.at)
        rows, size = [], 0
        for path in partition.paths:
            for row in self._rows(fs, path, partition.first, partition.last):
                rows.append({"path": self._name(path)} | row)
                size += 200 + len(row.get("content") or b"")
                if size > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _rows(self, fs: pafs.FileSystem, path: str, first: int, last: int | None) -> Iterator[dict]:
        said = lambda e: f"{type(e).__name__}: {e}"
        try:
            with fs.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                for place, x in enumerate(z.infolist()[first:last], first):
                    if self._wanted(x):
                        row = {"entry": x.filename, "place": place, "size": x.file_size}
                        try:
                            row["content"] = z.read(x)
                        except Exception as error:  # a damaged entry is data
                            row["error"] = said(error)
                        yield row
        except Exception as error:  # a damaged archive too
            if not self.tests["entry"]:
                yield {"error": said(error)}


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def entries(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The entries of the archives at ``path``: path, entry, place, size, error, content."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("lectern_archive").options(**options).load(path)
