"""A data source for folders of texts and of canonical JSON.

    spark.dataSource.register(Texts)
    spark.read.format("textlens").option("path", folder).load()
    found.write.format("textlens").mode("append").option("path", folder).save()

Reading gives name, format, text and error: a text that isn't UTF-8 has an error and no
text, and is never mended. With ``lines`` each line is a document, named by its file and
first byte, else each file is one. Files are read recursively; those and the folders that
begin with ``_`` or ``.`` are left out. A partition is about ``partitionBytes`` (32 MB) of
files or, by lines, of a file: a line belongs to the partition that it starts in. Memory
of a task is a batch of ``BATCH`` bytes or one document.

Writing takes one string column, a document a row, one line each (null rows are left
out; a document with a line break of its own is refused). Tasks write under
``_temporary`` with names of their own, so that a task that is lost and run again, or
twice, leaves no trace: files are moved to their place by the driver once all tasks have
ended, old ones go then where the mode is overwrite, and ``_SUCCESS`` is written last.
With the option ``compression`` ``zstd`` files are packed (``.zst``); they are unpacked as a
stream where they are read, and not cut.
What a task leaves that outlives its job's abort stays there and is never read.

``path`` is a local (or mounted) folder or any address that pyarrow has a file system for.
"""

from __future__ import annotations

import io
import posixpath
import sys
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of text in a batch, about.
BATCH = 4_000_000
PARTITION = 32 * 1024 * 1024
SCHEMA = pa.schema([("name", pa.string()), ("format", pa.string()), ("text", pa.string()), ("error", pa.string())])
_MARKDOWN = (".md", ".markdown")
#: Files that are unpacked as they are read, and so never cut.
PACKED = ".zst"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[fs.FileInfo]:
    """Files under ``path`` (or it alone) by name, without what is hidden below it."""
    system, root = _opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    inside = lambda f: posixpath.relpath(f.path, info.path).split("/")
    return sorted((f for f in found if f.type == fs.FileType.File and not any(p[0] in "_." for p in inside(f))), key=lambda f: f.path)


@dataclass
class Part(InputPartition):
    """(file, first byte, byte behind the last) of each piece."""

    pieces: list[tuple[str, int, int]]


def parts(files: list[tuple[str, int]], size: int, lines: bool) -> list[Part]:
    """Pieces of about ``size`` bytes: neighbouring small files together; by lines, large ones cut."""
    out: list[Part] = []
    room = 0
    for path, length in files:
        at = 0
        while at < length or at == 0:
            stop = min(at + size, length) if lines and not path.endswith(PACKED) else length
            if not out or room < stop - at:
                out.append(Part([]))
                room = size
            out[-1].pieces.append((path, at, stop))
            room -= stop - at
            at = max(stop, 1)
    return out


def _lines(file: io.BufferedReader, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines that start in the piece, without their breaks."""
    at = start
    if start:
        file.seek(start - 1)
        at = start - 1 + len(file.readline())
    while at < stop and (line := file.readline()):
        yield at, line.rstrip(b"\r\n")
        at += len(line)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.by_line = options["path"], options.get("lines", "false").lower() == "true"
        self.size = int(options.get("partitionbytes", PARTITION))
        if self.size < 1:
            raise ValueError("partitionBytes must be positive")

    def partitions(self) -> list[Part]:
        return parts([(f.path, f.size) for f in _listed(self.path)], self.size, self.by_line) or [Part([])]

    def _documents(self, part: Part) -> Iterator[tuple[str, bytes]]:
        system = _opened(self.path)[0]
        for path, start, stop in part.pieces:
            packed = path.endswith(PACKED)
            stop = sys.maxsize if packed else stop  # of what is unpacked
            with system.open_input_stream(path, compression="zstd") if packed else system.open_input_file(path) as raw:
                if self.by_line:
                    yield from ((f"{path}#{at}", line) for at, line in _lines(io.BufferedReader(raw, 1 << 20), start, stop))
                else:
                    yield path, raw.read()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for name, data in self._documents(partition):
            form = "markdown" if name.lower().endswith(_MARKDOWN) else "plain"
            try:
                rows.append((name, form, data.decode("utf-8"), None))
            except UnicodeDecodeError:
                rows.append((name, None, None, "invalid-utf8"))
            held += len(data) + len(name)
            if held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, packed: bool = False) -> None:
        self.path, self.overwrite, self.job, self.packed = path, overwrite, uuid.uuid4().hex, packed

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        system, root = _opened(self.path)
        root = root.rstrip("/")
        return system, root, f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, staging = self._staging()
        file, out = f"part-{uuid.uuid4().hex}.json" + (PACKED if self.packed else ""), None
        try:
            for batch in iterator:
                for line in batch.column(0).cast(pa.large_string()).drop_null():
                    data = line.as_py().encode()
                    if b"\n" in data or b"\r" in data:
                        raise ValueError("a document has a line break")
                    if out is None:
                        system.create_dir(staging, recursive=True)
                        out = system.open_output_stream(f"{staging}/{file}", compression="zstd" if self.packed else None, buffer_size=1 << 20)
                    out.write(data + b"\n")
        finally:
            if out is not None:
                out.close()
        return Written(file if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, staging = self._staging()
        system.create_dir(root, recursive=True)
        old = [f.path for f in _listed(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.file is not None:
                system.move(f"{staging}/{m.file}", f"{root}/{m.file}")
        for path in old:
            system.delete_file(path)
        self._clear()
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes what this job staged, and the common folder where no other job has anything in it."""
        system, root, staging = self._staging()
        for folder in (staging, f"{root}/_temporary"):
            if system.get_file_info(folder).type == fs.FileType.Directory and (folder == staging or not system.get_file_info(fs.FileSelector(folder))):
                system.delete_dir(folder)


class Texts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textlens"

    def schema(self) -> str:
        return "name string, format string, text string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if len(schema.fields) != 1 or schema.fields[0].dataType.simpleString() != "string":
            raise ValueError("one string column is written, a document a row")
        packing = self.options.get("compression", "none").lower()
        if packing not in ("none", "zstd"):
            raise ValueError("compression is none or zstd")
        return _Writer(self.options["path"], overwrite, packing == "zstd")


def register(spark: SparkSession) -> None:
    """Makes the format ``textlens`` known to the session."""
    spark.dataSource.register(Texts)


def scratch(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share (``spark.checkpoint.dir``); a temporary one for a local session without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textlens-files-")
    return f"{folder.rstrip('/')}/texts-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read from there, for plans that read them more than once."""
    folder = scratch(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
