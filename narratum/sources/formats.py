"""Formats for spark.read and df.write: archives member by member, and files under names of their own.

Both reach any store that Arrow's filesystems do (local and shared folders, HDFS, S3). Where only Spark can read, `epub.members`
takes archives from Spark's own reader.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import epub

#: Bytes of archives that a task reads.
PART_BYTES = 128 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its name there."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def uri_of(path: str, name: str) -> str:
    """A file's name as an id: with the scheme and host of the path under which it was found, like Spark's own readers."""
    if "://" in path and not path.startswith("file:"):
        scheme, _, rest = path.partition("://")
        return f"{scheme}://{rest.partition('/')[0]}/{name.lstrip('/')}" if scheme == "hdfs" else f"{scheme}://{name}"
    return f"file:{name}"


@dataclass
class Archives(InputPartition):
    names: list[str]


class EpubReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.suffix, self.strict = options.get("suffix", ".epub"), options.get("strict", "false").lower() == "true"
        self.most, self.part = int(options.get("memberbytes", epub.MEMBER_BYTES)), int(options.get("partitionbytes", PART_BYTES))
        self.pattern = options.get("members")

    def wanted(self, path: str) -> bool:
        return self.pattern is None or re.search(self.pattern, path) is not None

    def partitions(self) -> Sequence[InputPartition]:
        """Archives dealt to tasks by their size on disk."""
        system, base = opened(self.path)
        info = system.get_file_info(base)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        out, weight = [], 0
        for file in sorted((f for f in found if f.is_file and f.path.endswith(self.suffix)), key=lambda f: f.path):
            if not out or weight + file.size > self.part:
                out.append([])
                weight = 0
            out[-1].append(file.path)
            weight += file.size
        return [Archives(names) for names in out] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)

        def rows() -> Iterator[dict]:
            for name in partition.names:
                book = uri_of(self.path, name)
                try:
                    with system.open_input_file(name) as file:
                        yield from epub.archive_rows(book, file, self.wanted, self.strict, self.most)
                except OSError as error:
                    yield {"book_id": book, "error": f"{type(error).__name__}: {error}"}

        yield from epub.batched(rows(), to_arrow_schema(self.schema))


class Epub(DataSource):
    """spark.read.format("epub").load(path): (book_id, path, bytes, error) of the members of all archives below a path.

    Of an archive its central directory is read, then the members wanted, one at a time. Options: members (a pattern of paths; tests
    aren't taken from the query, as Spark would hold one scan's against all scans of a frame), strict (the exact media
    type), suffix, memberBytes (a larger member is an error row), partitionBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return epub.MEMBERS

    def reader(self, schema: StructType) -> EpubReader:
        return EpubReader(schema, {k.lower(): v for k, v in self.options.items()})


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    """Tasks write to a folder of their attempt's own; the commit moves the files of the attempts that count."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.base, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        self.names = schema.fieldNames()
        if "path" not in self.names or "content" not in self.names:
            raise ValueError("files need the columns path and content")

    def write(self, rows: Iterator[Row]) -> Written:
        system, base = opened(self.base)
        own, moves = f"{base}/{self.staging}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=True)
        for k, row in enumerate(rows):
            name = row["path"]
            if name is None or any(part in ("", ".", "..") for part in name.split("/")):
                raise ValueError(f"not a name for a file: {name}")
            with system.open_output_stream(f"{own}/{k}") as file:
                content = row["content"]
                file.write(b"" if content is None else content.encode("utf-8") if isinstance(content, str) else bytes(content))
            moves.append((f"{own}/{k}", f"{base}/{name}"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self.base)
        moves = [move for m in messages if m is not None for move in m.moves]
        names = [to for _, to in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"two files of one name: {next(n for n in names if names.count(n) > 1)}")
        there = {f.path for f in system.get_file_info(names) if f.type != fs.FileType.NotFound} if not self.overwrite else ()
        if there:
            self.abort(messages)
            raise ValueError(f"there is a file already: {min(there)}")
        for folder in {n.rpartition("/")[0] for n in names}:
            system.create_dir(folder, recursive=True)
        for at, to in moves:
            system.move(at, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = opened(self.base)
        try:
            system.delete_dir(f"{base}/{self.staging}")
        except OSError:  # there is none, or a task still writes to it
            return


class NamedFiles(DataSource):
    """df.write.format("named_files").save(path): a file for each row (path, content), under its own name below the path.

    All files appear when the job commits, each once, whatever attempts its tasks took; a job that fails leaves none of them (tasks that
    still ran at its end may leave a `_staging-` folder). Names must differ. Appending to a folder that has one of the names is an error; overwriting replaces files of the same names only.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(schema, {k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(Epub)
    spark.dataSource.register(NamedFiles)


def read_epub(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("epub").options(**options).load(path)


def write_files(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows (path, content) to files."""
    register(df.sparkSession)
    df.select("path", "content").write.format("named_files").mode(mode).save(path)
