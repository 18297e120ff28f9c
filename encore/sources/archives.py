"""Export archives by ranged reads.

The folder is listed by Spark without reading any file. A task then opens an archive as a seekable file and reads its
directory, which is at its end: that gives a row per member, and is all that classifying archives (S4) takes, whatever
their size. The members that are wanted are chosen from those rows, dealt over the tasks by size, and each is read and
unpacked by itself. So an archive of any size is split over the cluster, and what is filtered out is never read.

Files are opened through ``pyarrow.fs`` on the executors (local, HDFS, S3, GCS and Azure paths). For a store that only
Spark's own readers reach, ``ranged=False`` reads whole archives with ``binaryFile`` instead.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "archive string, member string, size bigint"
_MANIFEST_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64())])
_CONTENT = "archive string, member string, content string"
_CONTENT_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.string())])
MEMBERS_PER_BATCH = 10_000


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name of a path as Spark writes it (``/x``, ``file:/x``, ``s3a://…``, ``hdfs://…``)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    if scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&%"))


class RangedFile:
    """An Arrow file that refuses to seek before its start as Python's files do, which the zip reader relies on."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def seek(self, offset: int, whence: int = 0) -> int:
        if (self.size if whence == 2 else 0) + offset < 0 and whence != 1:
            raise OSError("seek before the start")
        return self.file.seek(offset, whence)

    def __getattr__(self, name: str):
        return getattr(self.file, name)


def opened(path: str) -> RangedFile:
    """A seekable file for reading."""
    filesystem, name = _filesystem(path)
    return RangedFile(filesystem.open_input_file(name))


def created(path: str) -> BinaryIO:
    """A file for writing bytes as they are, replacing one of this name; its folder is made."""
    filesystem, name = _filesystem(path)
    filesystem.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return filesystem.open_output_stream(name, compression=None)  # else a name in .gz is compressed once more


def _directory(file: BinaryIO, path: str) -> Iterator[tuple[str, str, int]]:
    with zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                yield path, info.filename, info.file_size


def _manifest_rows(paths: Iterator[tuple[str, BinaryIO]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, str, int]] = []
    for path, file in paths:
        for row in _directory(file, path):
            rows.append(row)
            if len(rows) >= MEMBERS_PER_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_MANIFEST_ARROW)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_MANIFEST_ARROW)


def _list_ranged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _manifest_rows((path, opened(path)) for part in parts for path in part.column(0).to_pylist())


def _list_whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _manifest_rows((path, io.BytesIO(blob)) for part in parts
                              for path, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))


def manifest(spark: SparkSession, path: str, ranged: bool = True) -> DataFrame:
    """``archive, member, size`` of every file in every zip under ``path``, from the archives' directories."""
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    if not ranged:
        return zips.select("path", "content").mapInArrow(_list_whole, _MANIFEST)
    # only the path is read, no content; the archives are dealt by their path, as their sizes say nothing here
    return zips.select("path").repartition("path").mapInArrow(_list_ranged, _MANIFEST)


def _text(data: bytes) -> str:
    """UTF-8 text; other bytes give a text that is no JSON, so that the member counts as malformed."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "not UTF-8"


def _read_ranged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members one at a time; an archive stays open while its members come in a row."""
    name, archive = None, None
    try:
        for part in parts:
            for path, member in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if path != name:
                    if archive is not None:
                        archive.close()
                    name, archive = path, zipfile.ZipFile(opened(path))
                yield pa.RecordBatch.from_pylist(
                    [{"archive": path, "member": member, "content": _text(archive.read(member))}], schema=_CONTENT_ARROW)
    finally:
        if archive is not None:
            archive.close()


def _read_whole(wanted: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                    for member in archive.namelist():
                        if re.search(wanted, member):
                            yield pa.RecordBatch.from_pylist(
                                [{"archive": path, "member": member, "content": _text(archive.read(member))}],
                                schema=_CONTENT_ARROW)

    return run


def contents(spark: SparkSession, path: str, wanted: str, ranged: bool = True, bytes_per_task: int = 64 << 20) -> DataFrame:
    """``archive, member, content`` of the members whose name the regular expression ``wanted`` finds.

    The members are dealt to tasks of about ``bytes_per_task`` unpacked bytes, a member to one task.
    """
    if not ranged:
        zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
        return zips.mapInArrow(_read_whole(wanted), _CONTENT)
    members = manifest(spark, path).where(F.col("member").rlike(wanted))
    total, number = members.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()  # the directories are read once for both
    tasks = max(1, -(-total // bytes_per_task), min(int(spark.conf.get("spark.sql.shuffle.partitions")), number))
    dealt = members.repartition(int(tasks), "archive", "member").sortWithinPartitions("archive", "member")
    return dealt.select("archive", "member").mapInArrow(_read_ranged, _CONTENT)
