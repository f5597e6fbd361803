"""A data source of record files: one JSON object a line, in parts of files, with what can't be read as rows of its own.

    spark.dataSource.register(RecordSource)
    spark.read.format("records").schema("doc_id long, text string, _file string, _at long, _error string").load(folder)
    spark.readStream.format("records").schema(...).load(folder)
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

#: Bytes of a part of a file, unless the option partBytes says otherwise.
PART = 16 << 20
#: Columns that tell where a row stands and what is wrong with it; all optional.
FILE, AT, ERROR = "_file", "_at", "_error"
WHOLE = {IntegerType: 1 << 31, LongType: 1 << 63}


class Unfit(ValueError):
    """A value that isn't what its column asks for."""


def fitted(value, kind: DataType, name: str):
    """The value, if it is of that kind; null fits any, whole numbers fit columns of fractions."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if value is None:
        return None
    if isinstance(kind, StringType) and isinstance(value, str):
        return value
    if isinstance(kind, BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, (DoubleType, FloatType)) and number and math.isfinite(value):
        return float(value)
    if type(kind) in WHOLE and number and value == int(value) and -WHOLE[type(kind)] <= value < WHOLE[type(kind)]:
        return int(value)
    if isinstance(kind, ArrayType) and isinstance(value, list):
        return [fitted(v, kind.elementType, name) for v in value]
    if isinstance(kind, StructType) and isinstance(value, dict):
        return tuple(fitted(value.get(f.name), f.dataType, f"{name}.{f.name}") for f in kind)
    raise Unfit(f"{name}: not {kind.simpleString()}")


def row_of(line: bytes, schema: StructType, file: str, at: int) -> tuple:
    """The record of a line by the columns of the schema: those it lacks are null, others are left out. A line that
    isn't a record, or has a value that doesn't fit, has nulls and the error."""
    known = {FILE: file, AT: at, ERROR: None}
    try:
        record = json.loads(line)
        if not isinstance(record, dict):
            raise Unfit("not an object")
        return tuple(known[f.name] if f.name in known else fitted(record.get(f.name), f.dataType, f.name) for f in schema)
    except (ValueError, OverflowError, RecursionError) as failure:
        known[ERROR] = f"{type(failure).__name__}: {failure}"
        return tuple(known.get(f.name) for f in schema)


@dataclass
class Part(InputPartition):
    """Lines of a file that begin from byte ``start`` on and before byte ``end``."""

    file: str
    start: int
    end: int


def listed(folder: str, suffix: str) -> list[tuple[str, int]]:
    """Files of a folder, or one file, with their sizes, by name. Names that begin with . or _ are left out."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    info = files.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


def lines_of(folder: str, part: Part) -> Iterator[tuple[int, bytes]]:
    """A part's lines that aren't blank, each with the byte it begins at. The line that a part's first byte is in the
    middle of belongs to the part before."""
    from pyarrow import fs

    files = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
    with io.BufferedReader(files.open_input_file(part.file), 1 << 20) as raw:
        at = part.start
        raw.seek(max(0, at - 1))
        if at and raw.read(1) != b"\n":
            at += len(raw.readline())
        while at < part.end:
            line = raw.readline()
            if not line:
                return
            if line.strip():
                yield at, line
            at += len(line)


def planned(files: list[tuple[str, int]], part: int) -> list[Part]:
    return [Part(name, start, min(size, start + part)) for name, size in files for start in range(0, size, part)]


class RecordReader(DataSourceReader):
    def __init__(self, schema: StructType, folder: str, suffix: str, part: int):
        self.schema, self.folder, self.suffix, self.part = schema, folder, suffix, part

    def partitions(self) -> list[Part]:
        return planned(listed(self.folder, self.suffix), self.part) or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.file:
            for at, line in lines_of(self.folder, partition):
                yield row_of(line, self.schema, partition.file, at)


class RecordStreamReader(RecordReader, DataSourceStreamReader):
    """Takes files in the order of their names: a new one must come after those that were read."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.folder, self.suffix)
        return {"last": files[-1][0] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return planned([f for f in listed(self.folder, self.suffix) if start["last"] < f[0] <= end["last"]], self.part)

    def commit(self, end: dict) -> None:
        pass


class RecordSource(DataSource):
    """Options: path; suffix of the files' names (.jsonl); partBytes. The schema must be given; see FILE, AT and ERROR."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def _given(self, schema: StructType) -> tuple:
        part = int(self.options.get("partBytes", PART))
        if part < 1:
            raise ValueError("partBytes must be positive")
        return schema, self.options["path"], self.options.get("suffix", ".jsonl"), part

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(*self._given(schema))

    def streamReader(self, schema: StructType) -> RecordStreamReader:  # noqa: N802
        return RecordStreamReader(*self._given(schema))
