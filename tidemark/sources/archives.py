"""Members of ZIP and tar archives, nested ones included, as rows.

A file's members are planned from ZIP central directories and tar headers, which are read at their places, not with the
members' bytes; names that don't match are left out of the plan. Each member that can be reached by its place is a task of its
own (or `taskBytes` of neighbours share one). What can't be reached by place is one task that streams it: a compressed tar, and
an archive that lies compressed in another. Every member's length and checksum are checked as it is read, and a member that fails
is named.

Paths are of any file system that pyarrow opens; nested names are joined by "!", as in "outer.tar.gz" -> "day1.zip!runs.csv".
"""

from __future__ import annotations

import bz2
import csv
import hashlib
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.session import ship

MEMBERS = "archive string, member string, bytes long, sha256 string, content binary, error string"
TARS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2")
CHUNK = 1 << 20
ROWS = 4096
#: Flag bit of an encrypted ZIP member, and the signature of a member's own header.
ENCRYPTED, LOCAL = 1, b"PK\x03\x04"


def _kind(name: str) -> str | None:
    low = name.lower()
    return "zip" if low.endswith(".zip") else "tar" if low.endswith(".tar") else "stream" if low.endswith(TARS) else None


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The file system of a path, and the archives at or below it in order of name."""
    system, root = fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)
    if system.get_file_info(root).type == fs.FileType.File:
        return system, [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and _kind(f.path))


class _Window(io.RawIOBase):
    """A part of a seekable file as a file."""

    def __init__(self, whole, start: int, size: int):
        self.whole, self.start, self.size, self.at = whole, start, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def readinto(self, buffer) -> int:
        wanted = max(0, min(len(buffer), self.size - self.at))
        self.whole.seek(self.start + self.at)
        got = self.whole.read(wanted) if wanted else b""
        buffer[: len(got)] = got
        self.at += len(got)
        return len(got)


class _Checked(io.RawIOBase):
    """The bytes of one member, unpacked piece by piece; its end fails unless length and checksum are those declared."""

    def __init__(self, packed, method: int, size: int, crc: int | None):
        self.packed, self.size, self.crc, self.seen, self.sum, self.rest = packed, size, crc, 0, 0, b""
        self.unpack = {zipfile.ZIP_STORED: lambda: None, zipfile.ZIP_DEFLATED: lambda: zlib.decompressobj(-15), zipfile.ZIP_BZIP2: bz2.BZ2Decompressor}[method]()
        self.over = False

    def readable(self) -> bool:
        return True

    def _more(self) -> bytes:
        while True:
            piece = self.packed.read(CHUNK)
            if self.unpack is None:
                return piece
            out = self.unpack.decompress(piece) if piece else getattr(self.unpack, "flush", bytes)()
            if out or not piece:
                return out

    def readinto(self, buffer) -> int:
        if not self.rest and not self.over:
            self.rest = self._more()
            self.seen, self.sum = self.seen + len(self.rest), zlib.crc32(self.rest, self.sum)
            if not self.rest:
                self.over = True
                if self.seen != self.size or self.crc is not None and self.sum != self.crc:
                    raise zipfile.BadZipFile(f"{self.seen} bytes of {self.size}, checksum {self.sum:08x}")
        got = self.rest[: len(buffer)]
        buffer[: len(got)] = got
        self.rest = self.rest[len(got) :]
        return len(got)


@dataclass
class Member:
    """Where a member's packed bytes lie in its file (None: it has to be streamed from the file's start), and what they should be."""

    name: str
    start: int | None = None
    packed: int = 0
    method: int = zipfile.ZIP_STORED
    size: int = 0
    crc: int | None = None
    header: bool = False


@dataclass
class MembersOf(InputPartition):
    archive: str
    members: list[Member] = field(default_factory=list)


def _plan(file, kind: str, prefix: str, base: int, wanted, opened) -> Iterator[Member]:
    """The members of a seekable archive that begins at `base` of its file; archives that lie in it unpacked are gone into."""

    def enter(name: str, start: int, size: int, whole) -> Iterator[Member]:
        inner = io.BufferedReader(_Window(whole, start, size))
        yield from _plan(inner, _kind(name), f"{prefix}{name}!", base + start, wanted, opened)

    if kind == "zip":
        for info in zipfile.ZipFile(file).infolist():
            name, stored = info.filename, info.compress_type == zipfile.ZIP_STORED
            if info.is_dir():
                continue
            place = Member(prefix + name, base + info.header_offset, info.compress_size, info.compress_type, info.file_size, info.CRC, True)
            if _kind(name) and opened(prefix + name):
                if stored and _kind(name) != "stream":
                    file.seek(info.header_offset)
                    yield from enter(name, info.header_offset + _header(file.read(30)), info.file_size, file)
                else:
                    yield place
            elif wanted(prefix + name):
                if info.flag_bits & ENCRYPTED:
                    raise ValueError(f"{prefix}{name} is encrypted")
                yield place
    else:
        for info in tarfile.open(fileobj=file, mode="r:"):
            place = Member(prefix + info.name, base + info.offset_data, info.size, size=info.size)
            if info.isfile() and _kind(info.name) and opened(prefix + info.name):
                yield from enter(info.name, info.offset_data, info.size, file) if _kind(info.name) != "stream" else [place]
            elif info.isfile() and wanted(prefix + info.name):
                yield place


def _header(head: bytes) -> int:
    """Length of a ZIP member's own header."""
    if head[:4] != LOCAL:
        raise zipfile.BadZipFile("no member begins here")
    return 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def _expand(name: str, stream, wanted, opened) -> Iterator[tuple[str, object]]:
    """The wanted members of a stream, each with its own to be read before the next: itself, or what an archive that is to be opened holds."""
    kind = _kind(name.rsplit("!", 1)[-1])
    if not kind or not opened(name):
        yield name, stream
        return
    asked = lambda inner: (_kind(inner) and opened(f"{name}!{inner}")) or wanted(f"{name}!{inner}")
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(stream.read())) as found:
                for info in found.infolist():
                    if not info.is_dir() and asked(info.filename):
                        yield from _expand(f"{name}!{info.filename}", found.open(info), wanted, opened)
        else:
            with tarfile.open(fileobj=stream, mode="r|*") as found:
                for info in found:
                    if info.isfile() and asked(info.name):
                        yield from _expand(f"{name}!{info.name}", found.extractfile(info), wanted, opened)
    except BROKEN as problem:
        raise BrokenMember(name, problem) from problem


class BrokenMember(ValueError):
    """A member that can't be read, by name."""

    def __init__(self, name: str, problem: Exception):
        super().__init__(f"{name}: {problem}")
        self.name, self.problem = name, problem

    def __reduce__(self):
        return BrokenMember, (self.name, self.problem)


BROKEN = (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, NotImplementedError, KeyError)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.members, self.containers = options["path"], options.get("members", "*"), options.get("containers", "*")
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.task_bytes = int(options.get("taskbytes", 0))

    def _wanted(self, name: str) -> bool:
        return fnmatch(name, self.members)

    def _opened(self, name: str) -> bool:
        return fnmatch(name, self.containers)

    def _planned(self, system: fs.FileSystem, path: str) -> list[MembersOf]:
        """A file's members as tasks: neighbours share one while they have fewer than `task_bytes` together."""
        kind = _kind(path)
        if kind is None:
            raise ValueError(f"{path} has no archive's name")
        if kind == "stream":
            return [MembersOf(path, [Member("")])]
        try:
            with system.open_input_file(path) as file:
                found = list(_plan(file, kind, "", 0, self._wanted, self._opened))
        except BROKEN as problem:
            if not self.permissive:
                raise BrokenMember(path, problem) from problem
            return [MembersOf(path, [Member("")])]  # the task that streams it tells what is wrong
        tasks, held = [], 0
        for member in found:
            if not tasks or held + member.packed > self.task_bytes:
                tasks.append(MembersOf(path))
                held = 0
            tasks[-1].members.append(member)
            held += member.packed
        return tasks

    def partitions(self) -> list[MembersOf]:
        system, paths = _files(self.path)
        with ThreadPoolExecutor(8) as pool:
            return [task for tasks in pool.map(lambda path: self._planned(system, path), paths) for task in tasks]

    def streams(self, task: MembersOf) -> Iterator[tuple[str, object]]:
        """Name and stream of each member of a task."""
        system, _ = _files(self.path)
        with system.open_input_file(task.archive) as file:
            for member in task.members:
                if member.start is None:
                    inside = lambda name: name[len(task.archive) + 1 :]
                    opened = lambda name: name == task.archive or self._opened(inside(name))
                    try:
                        for name, stream in _expand(task.archive, file, lambda name: self._wanted(inside(name)), opened):
                            yield inside(name), stream
                    except BrokenMember as broken:
                        raise BrokenMember(inside(broken.name), broken.problem) from broken
                    continue
                try:
                    file.seek(member.start)
                    at = member.start + (_header(file.read(30)) if member.header else 0)
                except BROKEN as problem:
                    raise BrokenMember(member.name, problem) from problem
                packed = io.BufferedReader(_Window(file, at, member.packed), CHUNK)
                yield from _expand(member.name, io.BufferedReader(_Checked(packed, member.method, member.size, member.crc)), self._wanted, self._opened)

    def read(self, partition: MembersOf) -> Iterator[pa.RecordBatch]:
        """Each member as one row: its bytes, their number and digest; with mode PERMISSIVE an error in place of them."""
        kinds = pa.schema([("archive", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        row = lambda *values: pa.RecordBatch.from_pylist([dict(zip(kinds.names, values))], kinds)
        found = self.streams(partition)
        while True:
            name = None
            try:
                name, stream = next(found)
                content = stream.read()
                yield row(partition.archive, name, len(content), hashlib.sha256(content).hexdigest(), content, None)
            except StopIteration:
                return
            except (BrokenMember, *BROKEN) as problem:
                broken = problem if isinstance(problem, BrokenMember) else BrokenMember(name or "", problem)
                if not self.permissive:
                    raise BrokenMember(f"{partition.archive}!{broken.name}".rstrip("!"), broken.problem) from problem
                yield row(partition.archive, broken.name, None, None, None, str(broken.problem))
                if name is None:
                    return


class _CsvReader(_Reader):
    """Rows of CSV members, streamed: a member is never held whole."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options)
        self.columns = [c for c in schema.names if c not in ("archive", "member", "line")]
        self.names = schema.names

    def read(self, partition: MembersOf) -> Iterator[pa.RecordBatch]:
        for name, stream in self.streams(partition):
            try:
                rows = csv.reader(io.TextIOWrapper(stream, "utf-8-sig", newline=""), strict=True)
                header = next(rows, [])
                lacks = [c for c in self.columns if c not in header]
                if lacks:
                    raise KeyError(f"columns {', '.join(lacks)} are missing")
                at, held = [header.index(c) for c in self.columns], []
                for number, row in enumerate(rows, 1):
                    if not any(row):
                        continue
                    if len(row) != len(header):
                        raise KeyError(f"row {number} has {len(row)} fields of {len(header)}")
                    held.append((number, *(row[k] or None for k in at)))
                    if len(held) == ROWS:
                        yield self._batch(partition.archive, name, held)
                        held = []
                if held:
                    yield self._batch(partition.archive, name, held)
            except (*BROKEN, csv.Error, UnicodeDecodeError) as problem:
                raise BrokenMember(f"{partition.archive}!{name}", problem) from problem

    def _batch(self, archive: str, name: str, rows: list[tuple]) -> pa.RecordBatch:
        line, *values = zip(*rows)
        made = {"archive": pa.array([archive] * len(rows)), "member": pa.array([name] * len(rows)), "line": pa.array(line, pa.int64())}
        made |= {c: pa.array(v, pa.string()) for c, v in zip(self.columns, values)}
        return pa.RecordBatch.from_arrays([made[c] for c in self.names], names=self.names)


class ArchiveSource(DataSource):
    """Options: path; members and containers (globs of nested names); mode (FAILFAST or PERMISSIVE); taskBytes.

    Without a schema, members come as rows of MEMBERS. With one, members are CSV files whose headers must hold its columns (all text;
    archive, member and line may be among them), and their rows come.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        plain = schema.names == [c.split()[0] for c in MEMBERS.split(", ")]
        return _Reader(self.options) if plain else _CsvReader(self.options, schema)


def _load(spark: SparkSession, path: str, options: dict, schema: str | None) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format(ArchiveSource.name()).options(**options)
    return (reader.schema(schema) if schema else reader).option("path", path).load()


def read_archives(spark: SparkSession, path: str, members: str = "*", containers: str = "*", permissive: bool = False, task_bytes: int = 0) -> DataFrame:
    """Members (archive, member, bytes, sha256, content, error) of the archives at a path that match a glob, nested ones included.

    A glob's * also matches slashes. `containers` names the archives inside of archives that are opened; others count as members.
    A member that can't be read fails the job by name; if `permissive`, it is a row with an error and no content.
    """
    mode = "PERMISSIVE" if permissive else "FAILFAST"
    return _load(spark, path, {"members": members, "containers": containers, "mode": mode, "taskBytes": str(task_bytes)}, None)


def read_archived_csv(spark: SparkSession, path: str, columns: list[str], members: str = "*.csv", containers: str = "*", task_bytes: int = 0) -> DataFrame:
    """Rows (archive, member, line, and the columns named, as text) of the CSV members of archives; blank fields are null.

    A member without one of the columns, with a row of another width or with a wrong checksum fails the job by name.
    """
    schema = ", ".join(["archive string", "member string", "line long", *(f"`{c}` string" for c in columns)])
    return _load(spark, path, {"members": members, "containers": containers, "taskBytes": str(task_bytes)}, schema)


def snapshot_of(member: Column, pattern: str = r"(\d{4}-\d{2}-\d{2}(?:T[\d-]+)?)") -> Column:
    """The time stamp in a member's name, or null: what snapshots of one archive are told apart by."""
    found = F.regexp_extract(member, pattern, 1)
    return F.when(found != "", found)


def missing_members(members: DataFrame, snapshot: str, required: list[str]) -> DataFrame:
    """(snapshot, name) of each required file that a snapshot lacks; `members` has the snapshot and member."""
    held = members.select(snapshot, F.regexp_extract("member", r"([^/!]+)$", 1).alias("name"))
    wanted = members.select(snapshot).distinct().select(snapshot, F.explode(F.array(*map(F.lit, required))).alias("name"))
    return wanted.join(held, [snapshot, "name"], "left_anti")
