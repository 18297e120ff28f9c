"""Many small files by tasks: a folder is listed and its files are read on the executors, so that the driver holds none of their names.

Spark's own readers keep the name, times and place of every file on the driver, some kilobytes each: a folder of some
hundred thousand small documents fills it. Here the names are rows. Files are opened through ``pyarrow.fs`` as archives are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from encore.session import is_local
from encore.sources import archives

_LISTED = "path string, modified timestamp, folder boolean"
_LISTED_ARROW = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])
_TEXT = "path string, modified timestamp, content string"
_TEXT_ARROW = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.string())])
PER_BATCH = 10_000
BYTES_PER_BATCH = 4 << 20
# what Java quotes in the path of a URI
_QUOTED = re.compile(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]')


def by_tasks(spark: SparkSession, path: str) -> bool:
    """Whether tasks can list and read ``path``: no glob, a folder or file that is there, in a store that ``pyarrow.fs`` knows."""
    if re.search(r"[*?\[{]", path) or ":" not in path and not (is_local(spark) and path.startswith("/")):
        return False
    try:
        filesystem, name = archives._filesystem(path)
        return filesystem.get_file_info(name).type in (fs.FileType.Directory, fs.FileType.File)
    except (OSError, pa.ArrowException):
        return False


def shown(root: str, name: str, path: str) -> str:
    """The file of this path under the folder ``root`` (``name`` in its store) as Spark's ``_metadata.file_path`` shows it."""
    base = re.sub("^file:/*", "file:/", root if ":" in root else "file:" + root).rstrip("/")
    return _QUOTED.sub(lambda m: f"%{ord(m[0]):02X}", base + path[len(name.rstrip("/")):])


def _hidden(name: str) -> bool:
    """Spark's rule for names that are no data."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(filesystem: fs.FileSystem, name: str, suffix: str, after: int | None) -> Iterator[tuple[str, int, bool]]:
    """What is directly in a folder: files (modified after ``after``, in milliseconds) and folders."""
    for info in filesystem.get_file_info(fs.FileSelector(name)):
        if _hidden(info.base_name):
            continue
        if info.type == fs.FileType.Directory:
            yield info.path, 0, True
        elif info.base_name.endswith(suffix):
            modified = info.mtime_ns // 1_000_000
            if after is None or modified > after:
                yield info.path, modified * 1000, False


def _batches(rows: Iterator[tuple[str, int, bool]]) -> Iterator[pa.RecordBatch]:
    some: list[tuple[str, int, bool]] = []
    for row in rows:
        some.append(row)
        if len(some) >= PER_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _LISTED_ARROW, strict=True)], schema=_LISTED_ARROW)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _LISTED_ARROW, strict=True)], schema=_LISTED_ARROW)


def _list_top(root: str, suffix: str, after: int | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, name = archives._filesystem(root)
        for part in parts:
            for _ in range(part.num_rows):
                info = filesystem.get_file_info(name)
                if info.type == fs.FileType.File:
                    modified = info.mtime_ns // 1_000_000
                    yield from _batches(iter([(name, modified * 1000, False)] if after is None or modified > after else []))
                else:
                    yield from _batches(_entries(filesystem, name, suffix, after))

    return run


def _list_below(root: str, suffix: str, after: int | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = archives._filesystem(root)

        def files() -> Iterator[tuple[str, int, bool]]:
            for part in parts:
                times = part.column(1).cast(pa.int64()).to_pylist()
                for path, modified, folder in zip(part.column(0).to_pylist(), times, part.column(2).to_pylist(), strict=True):
                    if not folder:
                        yield path, modified, False
                        continue
                    left = [path]
                    while left:
                        for entry in _entries(filesystem, left.pop(), suffix, after):
                            if entry[2]:
                                left.append(entry[0])
                            else:
                                yield entry

        yield from _batches(files())

    return run


def _text(data: bytes) -> str:
    """Text in the encoding that JSON readers tell from its first bytes; what is none gives a text that is no JSON."""
    try:
        return data.decode(json.detect_encoding(data))
    except UnicodeDecodeError:
        return "not UTF-8"


def _read(root: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, name = archives._filesystem(root)
        for part in parts:
            rows, size = [], 0
            for path, modified in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(path) as file:
                    text = _text(file.read())
                rows.append({"path": shown(root, name, path), "modified": modified, "content": text})
                size += len(text)
                if size >= BYTES_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=_TEXT_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_TEXT_ARROW)

    return run


def texts(spark: SparkSession, root: str, suffix: str, after: int | None = None) -> DataFrame:
    """``path, modified, content`` of every file under ``root``, folders in it included, whose name ends in ``suffix``.

    ``after``: only files modified after this time, in milliseconds since 1970. One task lists ``root`` itself, others the
    folders in it, and the files are dealt over tasks by their path. Hidden names are left out as Spark's readers do.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.range(0, 1, 1, 1).mapInArrow(_list_top(root, suffix, after), _LISTED)
    files = top.repartition(tasks, "path").mapInArrow(_list_below(root, suffix, after), _LISTED)
    return files.select("path", "modified").repartition(tasks, "path").mapInArrow(_read(root), _TEXT)
