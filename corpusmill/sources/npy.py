"""NumPy files as a data source: ``spark.read.format("npy")`` and ``df.write.format("npy")``, after ``register``.

A reader's partition is a range of rows of one file, found behind its header, so a large file is read by many tasks and the
driver sees headers only. A writer's tasks write their files themselves, under names of their own; the driver's commit
moves those of the tasks that count to their place. Paths are local or shared folders, or any address that
``pyarrow.fs.FileSystem.from_uri`` knows.
"""

from __future__ import annotations

import fnmatch
import io
import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = 4096  # rows of an Arrow batch
SCHEMA = "path string, row long, tokens array<smallint>"
HEAD = 4096  # bytes that hold any header of a matrix


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def files_of(path: str) -> tuple[fs.FileSystem, list[str]]:
    """A file, all ``.npy`` files below a folder, or those that a pattern fits."""
    wild = any(c in path for c in "*?[")
    system, at = located(path)
    base = at
    while any(c in base for c in "*?["):
        base = posixpath.dirname(base)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return system, [base]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    there = [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
    # A star stands for part of one name, as everywhere in Spark.
    fits = lambda p: fnmatch.fnmatch(p, at) and p.count("/") == at.count("/") if wild else p.endswith(".npy")
    return system, sorted(p for p in there if fits(p) and "/_" not in p[len(base) :])


def header(content: bytes, path: str) -> tuple[int, int, int]:
    """Rows, columns and where they begin."""
    stream = io.BytesIO(content)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[np.lib.format.read_magic(stream)]
    shape, by_column, kind = read(stream)
    if len(shape) != 2 or by_column or kind != np.dtype("<i2"):
        raise ValueError(f"{path} is no matrix of 16-bit integers, row by row: {shape}, {kind}")
    return *shape, stream.tell()


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    count: int
    width: int
    begin: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rows", 65_536))

    def partitions(self) -> list[Rows]:
        system, found = files_of(self.path)
        out = []
        for path in found:
            with system.open_input_file(path) as f:
                n, width, begin = header(f.read(HEAD), path)
            out += [Rows(path, i, min(self.step, n - i), width, begin) for i in range(0, n, self.step)]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        with system.open_input_file(part.path) as f:
            for first in range(part.first, part.first + part.count, CHUNK):
                n = min(CHUNK, part.first + part.count - first)
                values = np.frombuffer(f.read_at(2 * n * part.width, part.begin + 2 * first * part.width), "<i2")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(first, first + n)), lists], names=["path", "row", "tokens"])


@dataclass
class Made(WriterCommitMessage):
    folder: str
    names: list[str] = field(default_factory=list)


class Writer(DataSourceArrowWriter):
    """Rows ``source, split, part, seq_id, tokens``, sorted by all of these: a file ``<source>/<split>-<first>.npy`` of each part."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.run, self.overwrite = options["path"], uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Made:
        system, base = located(self.path)
        # A repeated or speculative task has a folder of its own.
        made = Made(f"{base}/_temporary-{self.run}/{uuid.uuid4().hex}")
        held: list[np.ndarray] = []
        now = first = None

        def close() -> None:
            if held:
                source, split, _ = now
                made.names.append(f"{source}/{split}-{first:012d}.npy")
                target = f"{made.folder}/{made.names[-1]}"
                system.create_dir(posixpath.dirname(target), recursive=True)
                with system.open_output_stream(target) as out:
                    buffer = io.BytesIO()
                    np.save(buffer, np.concatenate(held).astype("<i2"))
                    out.write(buffer.getvalue())
                held.clear()

        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("source", "split", "part", "seq_id", "tokens")]
            keys = list(zip(*(c.to_pylist() for c in columns[:3]), strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != now:
                    close()
                    now, first = keys[a], columns[3][a].as_py()
                lists = columns[4].slice(a, b - a)
                held.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
        close()
        return made

    def commit(self, messages: list[Made | None]) -> None:
        system, base = located(self.path)
        names = sorted(n for m in messages if m for n in m.names)
        if self.overwrite and system.get_file_info(base).type == fs.FileType.Directory:
            for f in files_of(base)[1]:
                system.delete_file(f)
        for m in messages:
            for n in m.names if m else []:
                system.create_dir(posixpath.dirname(f"{base}/{n}"), recursive=True)
                system.move(f"{m.folder}/{n}", f"{base}/{n}")
        self._clean()
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Made | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, base = located(self.path)
        if system.get_file_info(f"{base}/_temporary-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_temporary-{self.run}")


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Npy)


def written_names(path: str) -> list[str]:
    """The files of the last write, as its commit recorded them."""
    system, base = located(path)
    with system.open_input_file(f"{base}/_SUCCESS") as f:
        return json.loads(f.read())
