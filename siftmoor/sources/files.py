"""Files of directory trees and ZIP archives as rows.

Spark's own listing drops names that begin with "_" or ".", which include
``__init__.py`` and ``.env``, so Python lists and reads.  Listing yields names
and sizes only: folders are handed on for some levels, so one root is listed by
many tasks, and names are spread over a stated number of tasks before any content
is read.  Names that admission turns away are never opened.  Roots and archives
must be reachable from every executor (a shared mount).

An archive is split: one task walks the lengths in its central directory and cuts
it into spans of whole entries, other tasks list the members of a span, and again
others read members, each opening the span it needs and not the whole directory.
"""

import io
import lzma
import os
import struct
import zipfile
import zlib
from collections import namedtuple
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftmoor.fixed import files as fx
from siftmoor.operators.admission import name_reason

NAMES = "repo_id string, root string, member string, path string, size_bytes bigint, chunk string, error string"
SPANS = "repo_id string, root string, span string, error string"
MEMBERS = "repo_id string, root string, member string, size_bytes bigint, chunk string, place bigint, top string, error string"
FILES = "repo_id string, path string, size_bytes bigint, content binary, error string"
NAMES_PER_BATCH = 10_000
BYTES_PER_BATCH = 4_000_000    # of contents that a task holds before it hands them on
CHUNK_BYTES = 16_000_000       # members of an archive that are read together
SPAN_BYTES = 1 << 20           # of a central directory, listed by one task
LEVELS = 3                     # steps of listing a tree; the last one walks all that is below

_ZIP_ERRORS = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, EOFError, OSError, RuntimeError, ValueError)


def _skipped(directory: str) -> bool:
    return directory in fx.SKIP_DIRECTORIES or directory.endswith(fx.SKIP_DIRECTORY_SUFFIX)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return map(namedtuple("Row", batch.schema.names)._make, zip(*(column.to_pylist() for column in batch.columns)))


def _batches(rows, schema: str, weight) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches that end when the weights of their rows reach 1."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def made(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), fields)], schema=fields)

    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= 1:
            batch, held, total = made(held), [], 0
            yield batch
    if held:
        yield made(held)


def _spread(table: DataFrame, *keys) -> DataFrame:
    """As many tasks as the session shuffles to: names are too thin to be dealt by their own bytes."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _folder(repo_id: str, root: str, folder: str, whole: bool) -> Iterator[tuple]:
    """Files of a folder as rows, and its subfolders as rows without a path, or if ``whole`` the files below them."""
    for directory, below, names in os.walk(folder):
        below[:] = [name for name in below if not _skipped(name)]
        for name in names:
            full = os.path.join(directory, name)
            try:
                size = os.path.getsize(full)
            except OSError:
                size = None
            yield repo_id, root, full, os.path.relpath(full, root).replace(os.sep, "/"), size, None, None
        if not whole:
            for name in below:
                full = os.path.join(directory, name)
                if not os.path.islink(full):
                    yield repo_id, root, full, None, None, None, None
            return


class _Span(io.RawIOBase):
    """An archive with only a span of its central directory, for ``zipfile`` to read.

    The archive's bytes from ``first`` on, then the entries of the span and an end record for them.  A span is told by
    ``first,start,size,entries``: where the archive begins in its file, and where the entries stand there.
    """

    def __init__(self, root: str, span: str):
        first, start, size, entries = map(int, span.split(",")[:4])
        self._file, self._first, self._at = open(root, "rb"), first, 0
        self._file.seek(start)
        directory = self._file.read(size)
        self._body = self._file.seek(0, os.SEEK_END) - first
        end = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, entries, entries, size, self._body)
        locator = struct.pack("<4sLQL", b"PK\6\7", 0, self._body + size, 1)
        self._tail = directory + end + locator + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        start = {os.SEEK_SET: 0, os.SEEK_CUR: self._at, os.SEEK_END: self._body + len(self._tail)}[whence]
        if start + offset < 0:
            raise OSError("before the start")
        self._at = start + offset
        return self._at

    def read(self, size: int = -1) -> bytes:
        size = self._body + len(self._tail) - self._at if size is None or size < 0 else size
        found = b""
        if self._at < self._body:
            self._file.seek(self._first + self._at)
            found = self._file.read(min(size, self._body - self._at))
            self._at += len(found)
        if self._at >= self._body and size > len(found):
            rest = self._tail[self._at - self._body : self._at - self._body + size - len(found)]
            self._at += len(rest)
            found += rest
        return found

    def close(self) -> None:
        self._file.close()
        super().close()


def _directory(handle) -> tuple[int, int, int]:
    """Where an archive begins in its file, and start and size of its central directory there."""
    length = handle.seek(0, os.SEEK_END)
    handle.seek(max(0, length - (1 << 16) - 22))
    tail = handle.read()
    at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) - at < 22:
        raise zipfile.BadZipFile("no end record")
    size, offset = struct.unpack("<2L", tail[at + 12 : at + 20])
    stop = length - len(tail) + at
    if at >= 76 and tail[at - 20 : at - 16] == b"PK\6\7" and tail[at - 76 : at - 72] == b"PK\6\6":
        size, offset = struct.unpack("<2Q", tail[at - 36 : at - 20])
        stop -= 76
    if stop - size - offset < 0:
        raise zipfile.BadZipFile("directory out of the file")
    return stop - size - offset, stop - size, size


def _spans(repo_id: str, root: str) -> Iterator[tuple]:
    """The central directory cut into spans of whole entries; only the lengths of entries are looked at."""
    spans = []
    try:
        with open(root, "rb") as handle:
            first, start, size = _directory(handle)
            handle.seek(start)
            begin = at = start
            entries, held, base = 0, b"", start
            while at < start + size:
                if at + 46 > base + len(held):
                    handle.seek(at)
                    held, base = handle.read(min(max(46, SPAN_BYTES), start + size - at)), at
                here = at - base
                if held[here : here + 4] != b"PK\1\2" or len(held) < here + 46:
                    raise zipfile.BadZipFile("no directory entry")
                at += 46 + sum(struct.unpack_from("<3H", held, here + 28))
                entries += 1
                if at - begin >= SPAN_BYTES or at >= start + size:
                    spans.append(f"{first},{begin},{at - begin},{entries}")
                    begin, entries = at, 0
            if at != start + size:
                raise zipfile.BadZipFile("directory cut off")
    except _ZIP_ERRORS as error:
        yield repo_id, root, None, _archive_error(error)
        return
    for span in spans:
        yield repo_id, root, span, None


def _archive_error(error: Exception) -> str:
    return "Downloaded file is not a valid ZIP archive" if isinstance(error, zipfile.BadZipFile) else str(error)


def _members(repo_id: str, root: str, span: str) -> Iterator[tuple]:
    """Members of a span.  Those that are read together share a ``chunk``; ``place`` grows through the archive."""
    try:
        with _Span(root, span) as part, zipfile.ZipFile(part) as archive:
            infos = archive.infolist()
    except _ZIP_ERRORS as error:
        yield repo_id, root, None, None, None, None, None, _archive_error(error)
        return
    upto, start = 0, int(span.split(",")[1])
    for number, info in enumerate(infos):
        top = info.filename.split("/")[0] if "/" in info.filename else None
        upto += info.file_size if info.file_size <= fx.MAX_FILE_BYTES else 0
        yield repo_id, root, info.filename, info.file_size, f"{span},{upto // CHUNK_BYTES}", start + number, top, None


def _listed(rows: DataFrame, of_row, schema: str = NAMES) -> DataFrame:
    def run(batches):
        found = (found for batch in batches for row in _rows(batch) for found in of_row(row))
        yield from _batches(found, schema, lambda row: 1 / NAMES_PER_BATCH)

    return rows.mapInArrow(run, schema)


def _read_plain(root: str, members, chunk: str | None) -> Iterator[tuple]:
    for member in members:
        try:
            with open(member, "rb") as handle:
                yield handle.read(), None
        except OSError:
            yield None, None


def _read_archive(root: str, members, chunk: str) -> Iterator[tuple]:
    left = list(members)
    try:
        with _Span(root, chunk) as part, zipfile.ZipFile(part) as archive:
            while left:
                try:
                    found = archive.read(left[0]), None
                except (KeyError, *_ZIP_ERRORS) as error:
                    found = None, str(error) or type(error).__name__
                left = left[1:]
                yield found
    except _ZIP_ERRORS as error:
        yield from ((None, str(error)) for _ in left)


def _contents(names: DataFrame, read) -> DataFrame:
    """Contents of the named files; those that admission knows by name or size to skip are never opened."""
    def rows(batches):
        for batch in batches:
            for (root, chunk), group in groupby(_rows(batch), lambda row: (row.root, row.chunk)):
                group = list(group)
                wanted, other = [row for row in group if row.wanted], [row for row in group if not row.wanted]
                for row, (content, error) in zip(wanted, read(root, [row.member for row in wanted], chunk)):
                    yield row.repo_id, row.path, row.size_bytes, content, error
                for row in other:
                    yield row.repo_id, row.path, row.size_bytes, b"" if row.size_bytes == 0 else None, None

    def run(batches):
        yield from _batches(rows(batches), FILES, lambda row: (1000 + len(row[3] or b"")) / BYTES_PER_BATCH)

    readable = F.coalesce(F.col("size_bytes").between(1, fx.MAX_FILE_BYTES), F.lit(False))
    named = names.where(F.col("path").isNotNull()).withColumn("wanted", readable & name_reason(F.col("path")).isNull())
    together = F.coalesce("chunk", "path")
    return _spread(named, "repo_id", "root", together).sortWithinPartitions("root", "chunk").mapInArrow(run, FILES)


def tree_names(roots: DataFrame) -> DataFrame:
    """Names and sizes below ``roots(repo_id, root)``; skipped directories are not entered."""
    names = roots.select("repo_id", "root", F.col("root").alias("member"), *[
        F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in NAMES.split(", ")[3:])])
    for level in range(1, LEVELS + 1):
        def step(row, whole=level == LEVELS):
            return [row] if row.path is not None else _folder(row.repo_id, row.root, row.member, whole)

        names = _listed(_spread(names, "repo_id", "member"), step)
    return names


def tree_files(roots: DataFrame) -> DataFrame:
    """``files(repo_id, path, size_bytes, content, error)`` of directory trees."""
    return _contents(tree_names(roots), _read_plain)


def archive_names(archives: DataFrame) -> DataFrame:
    """Members of ``archives(repo_id, root)``; an archive that cannot be read is one row with its ``error``.

    A root folder shared by all members that have a folder is cut off, other members are left out.  Of members with the
    same name the last one counts, as when an archive is unpacked.
    """
    key = ["repo_id", "root"]
    spans = _listed(_spread(archives.select(*key), *key), lambda row: _spans(row.repo_id, row.root), SPANS)
    good = spans.where(F.col("span").isNotNull())
    members = _listed(_spread(good, *key, "span"), lambda row: _members(row.repo_id, row.root, row.span), MEMBERS)
    listed = members.unionByName(spans.where(F.col("span").isNull()).drop("span"), allowMissingColumns=True)
    whole = listed.groupBy(*key).agg(F.min("top").alias("low"), F.max("top").alias("high"), F.max("error").alias("error"))
    prefix = F.when(F.col("low") == F.col("high"), F.concat("low", F.lit("/"))).otherwise("")
    last = listed.where(F.col("error").isNull()).groupBy(*key, "member").agg(F.max(F.struct("place", "size_bytes", "chunk")).alias("last"))
    sound = whole.where(F.col("error").isNull()).select(*key, prefix.alias("prefix"))
    inside = F.startswith("member", "prefix") & ~F.endswith("member", F.lit("/"))
    path = F.expr("substring(member, length(prefix) + 1)")
    found = last.join(sound, key).where(inside).select(*key, "member", path.alias("path"), "last.size_bytes", "last.chunk", F.lit(None).cast("string").alias("error"))
    failed = whole.where(F.col("error").isNotNull()).select(*key, "error")
    return found.unionByName(failed, allowMissingColumns=True)


def archive_files(names: DataFrame) -> DataFrame:
    """``files(repo_id, path, size_bytes, content, error)`` of the members listed by ``archive_names``.

    A member that cannot be unpacked has no content and an ``error``; ``archive_errors`` fails its repository.
    """
    return _contents(names, _read_archive)


def archive_errors(names: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``(repo_id, error)`` of archives that cannot be listed, with ``files`` also of members that cannot be unpacked.

    Members that are never opened (skipped by name or size) cannot be found damaged.
    """
    found = names.where(F.col("error").isNotNull()).select("repo_id", "error")
    if files is None:
        return found
    return found.union(files.where(F.col("error").isNotNull()).select("repo_id", "error"))
