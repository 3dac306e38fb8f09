"""Book libraries as a data source: chapter files of every book, read and written by groups.

``spark.dataSource.register(Library)`` makes the format ``book_library`` known.  Its rows are
files (book_id, file_name, text) of ``<library>/<book id>/<folder>/``; the option ``folder``
names the folder (``raw``, ``translated``; empty for the files of the book itself).  The path
may be a URI of any file system that pyarrow opens, shared by driver and executors.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FILES = "book_id string, file_name string, text string"
ARROW = pa.schema([("book_id", pa.string()), ("file_name", pa.string()), ("text", pa.string())])
#: Names the library itself uses; no book begins with it.
OWN = "_"
#: Books of one partition at most, and partitions that fewer books are spread over.
GROUP = 64
#: Bytes of text in one Arrow batch, unless one text is longer.
BATCH = 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Books(InputPartition):
    """A group of books that one task reads."""

    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    """What one task has moved into place."""

    files: int
    characters: int


class Library(DataSource):
    """The format ``book_library``."""

    @classmethod
    def name(cls) -> str:
        return "book_library"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return LibraryReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        names = [field.name for field in schema.fields]
        if names != ARROW.names:
            raise ValueError(f"columns of a library are {ARROW.names}, not {names}")
        return LibraryWriter(self.options)


class LibraryReader(DataSourceReader):
    """The driver lists books, a task the files of its books; a file that is gone by then, or
    that isn't UTF-8, is left out."""

    def __init__(self, options: dict[str, str]):
        self.path, self.folder = options["path"], options.get("folder", "raw")
        self.group = int(options.get("booksPerPartition", "0"))
        self.suffix = options.get("suffix", ".txt")

    def partitions(self) -> Sequence[InputPartition]:
        files, place = opened(self.path)
        found = files.get_file_info(fs.FileSelector(place, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(OWN))
        # Few books are spread, each may hold many files; of many books a task has at most GROUP.
        group = self.group or min(GROUP, max(1, -(-len(names) // GROUP)))
        # Spark reads at least one partition; the last one may be empty.
        return [Books(tuple(names[k : k + group])) for k in range(0, max(1, len(names)), group)]

    def read(self, partition: Books) -> Iterator[pa.RecordBatch]:
        files, place = opened(self.path)
        rows: list[tuple[str, str, str]] = []
        held = 0
        for book in partition.names:
            folder = posixpath.join(place, book, self.folder) if self.folder else posixpath.join(place, book)
            found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            for info in sorted(found, key=lambda f: f.base_name):
                if info.type != fs.FileType.File or not info.base_name.endswith(self.suffix):
                    continue
                try:
                    with files.open_input_stream(info.path) as stream:
                        text = stream.read().decode()
                except (FileNotFoundError, UnicodeDecodeError):
                    continue
                rows.append((book, info.base_name, text))
                held += len(text)
                if held >= BATCH:
                    yield batch_of(rows)
                    rows, held = [], 0
        yield batch_of(rows)


def batch_of(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=ARROW)


class LibraryWriter(DataSourceArrowWriter):
    """Files are whole or absent, and a job that ends well says so.

    A task writes below its own staging folder and moves its files into place when it has them
    all.  A file's name is its key, so a task that runs again puts the same files in place.  The
    job then writes ``_jobs/<id>.json`` with its totals; a job without one has not ended.
    Other files of a book stay.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.folder = options["path"], options.get("folder", "raw")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, place = opened(self.path)
        staging = posixpath.join(place, f"{OWN}staging", self.job, uuid.uuid4().hex)
        moves: list[tuple[str, str]] = []
        folders: set[str] = set()
        characters = 0
        files.create_dir(staging, recursive=True)
        for batch in iterator:
            for book, name, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                check_name(book)
                check_name(name)
                part = posixpath.join(staging, str(len(moves)))
                with files.open_output_stream(part) as stream:
                    stream.write((text or "").encode())
                folder = posixpath.join(place, book, self.folder) if self.folder else posixpath.join(place, book)
                folders.add(folder)
                moves.append((part, posixpath.join(folder, name)))
                characters += len(text or "")
        for folder in folders:
            files.create_dir(folder, recursive=True)
        for part, target in moves:
            files.move(part, target)
        return Written(len(moves), characters)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, place = opened(self.path)
        done = [m for m in messages if m is not None]
        totals = {"files": sum(m.files for m in done), "characters": sum(m.characters for m in done)}
        jobs = posixpath.join(place, f"{OWN}jobs")
        files.create_dir(jobs, recursive=True)
        with files.open_output_stream(posixpath.join(jobs, f"{self.job}.json")) as stream:
            stream.write(json.dumps(totals).encode())
        self._clean(files, place)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, files: fs.FileSystem, place: str) -> None:
        staging = posixpath.join(place, f"{OWN}staging", self.job)
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


def check_name(name: str | None) -> None:
    """A book or file name that stays inside the library."""
    if not name or name.startswith((OWN, ".")) or "/" in name:
        raise ValueError(f"no name of a book or file: {name!r}")
