"""A data source that lists the files below a folder, empty ones too (S7), and writers of many small files.

Spark's own file scans leave out files of length 0, so an intake could not report them.
The listing runs in tasks: the driver lists one level, each task walks some of its folders.
Paths are of any file system pyarrow opens (local or mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "file_listing"
BATCH_BYTES = 32 << 20
SCHEMA = "path string, filename string, length long, modified timestamp, content binary"
GROUPS = 64  # tasks at most, apart from one for the files of the folder itself


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Folders(InputPartition):
    def __init__(self, folders: list[str], files: list[str]):
        self.folders, self.files = folders, files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("maxbytes", options.get("maxBytes", 0)))

    def partitions(self) -> list[_Folders]:
        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(root))
        folders = sorted(f.path for f in found if f.type == fs.FileType.Directory)
        files = sorted(f.path for f in found if f.type == fs.FileType.File)
        parts = [_Folders(folders[i::GROUPS], files[i::GROUPS]) for i in range(GROUPS)]
        return [p for p in parts if p.folders or p.files] or [_Folders([], [])]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        infos = system.get_file_info(partition.files) if partition.files else []
        rows, size = [], 0
        for part in ([infos], *([system.get_file_info(fs.FileSelector(f, recursive=True))] for f in partition.folders)):
            for info in (x for group in part for x in group if x.type == fs.FileType.File):
                content = None
                if 0 < info.size <= self.most:
                    with system.open_input_stream(info.path) as f:
                        content = f.read()
                    size += len(content)
                rows.append((info.path, info.base_name, info.size, info.mtime, content))
                if size > BATCH_BYTES or len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows, size = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
        columns = list(zip(*rows)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "filename", "length", "modified", "content"])


class FileListing(DataSource):
    """Option ``path``; option ``maxBytes`` asks for the content of files up to that length."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def list_files(spark: SparkSession, path: str, max_bytes: int = 0) -> DataFrame:
    """path, filename, length, modified and, for files of 1 to ``max_bytes`` bytes, content."""
    spark.dataSource.register(FileListing)
    return spark.read.format(NAME).option("path", path).option("maxBytes", str(max_bytes)).load()


def write_files(files: DataFrame, root: str) -> None:
    """Write rows (name, content) as files below ``root``, from the tasks that hold them."""

    def put(rows) -> None:
        system, folder = _opened(root)
        for r in rows:
            target = f"{folder}/{r.name}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(target) as f:
                f.write(bytes(r.content or b""))

    files.select("name", "content").foreachPartition(put)


# Characters that Hive's folder names (``column=value``) hold as %XX, and the name of a missing value.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_MISSING = "__HIVE_DEFAULT_PARTITION__"


def folder_name(column: str, value: str | None) -> str:
    """Name of a value's folder, as Spark's readers understand it."""
    return f"{column}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else _MISSING}"


def _notes(root: str) -> str:
    """Table of the files (key, path) that ``write_folders`` wrote below ``root``, beside it."""
    return f"{root.rstrip('/')}.files"


def write_folders(lines: DataFrame, root: str, suffix: str, header: str = "") -> None:
    """Write (key, line) as text files, a folder per value of the first column, from the tasks
    that hold the rows; rows of a key must stand together in their partition.

    Files are made without Spark's commit, whose cost grows with their number. A file gets its name once it
    is whole, the same in every attempt of a task, and is noted with its key beside ``root``, where ``read_folders``
    finds it: no list of files goes through the driver. ``root`` must be new.
    """
    column = lines.columns[0]
    system, folder = _opened(root)
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        raise FileExistsError(root)
    system.create_dir(folder, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _opened(root)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}{suffix}"
        hidden = f"_{task.taskAttemptId()}-{name}"  # readers skip it, if a task is cut off
        before, target, out = (), None, None  # no key equals the first ``before``

        for batch in batches:
            keys, paths = [], []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != before:
                    before, last = key, target
                    target = f"{folder}/{folder_name(column, key)}"
                    if target != last:
                        if out is not None:
                            out.close()
                            system.move(f"{last}/{hidden}", f"{last}/{name}")
                        system.create_dir(target, recursive=True)
                        out = system.open_output_stream(f"{target}/{hidden}")
                        out.write(header.encode())
                        keys.append(key or None)
                        paths.append(f"{folder_name(column, key)}/{name}")
                out.write(f"{line}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(paths, pa.string())], ["key", "path"])
        if out is not None:
            out.close()
            system.move(f"{target}/{hidden}", f"{target}/{name}")

    lines.mapInArrow(put, "key string, path string").write.parquet(_notes(root))
    with system.open_output_stream(f"{folder}/_SUCCESS"):
        pass


def read_folders(spark: SparkSession, root: str, skip: int = 0) -> DataFrame:
    """Lines (key, line) of the files that ``write_folders`` wrote below ``root``, without the first ``skip``
    of each file. Tasks open the noted files; nothing is listed. Lines end as in Spark's readers."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _opened(root)
        keys, lines, size = [], [], 0
        names = ["key", "line"]
        for batch in batches:
            for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{folder}/{path}") as f, io.TextIOWrapper(f, "utf-8", "replace", newline=None) as text:
                    for i, line in enumerate(text):
                        if i < skip:
                            continue
                        keys.append(key)
                        lines.append(line[:-1] if line.endswith("\n") else line)
                        size += len(line)
                        if size > BATCH_BYTES >> 3 or len(lines) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names)
                            keys, lines, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names)

    tasks = max(GROUPS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.read.schema("key string, path string").parquet(_notes(root)).repartition(tasks).mapInArrow(get, "key string, line string")
