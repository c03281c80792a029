"""Revisions of files in a version-control repository, read from its objects: one row for each revision that changes a path.

The driver walks the commits of a ref. Tasks get runs of commits with their parents, look their paths up in the trees, and read the
contents of those that changed; objects are read loose or from packs, deltas included. The repository has to be on a file system that
all executors share.
"""

from __future__ import annotations

import hashlib
import heapq
import mmap
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.session import ship

REVISIONS = "revision string, committed long, path string, blob string, bytes long, sha256 string, content binary"
#: Fixed values of the formats: kinds of packed objects, and how an index of version 2 begins.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, REF_DELTA = 6, 7
INDEX = b"\xfftOc\x00\x00\x00\x02"


def _apply(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base: a list of copies from the base and insertions."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = delta[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    size, at = number(0)
    if size != len(base):
        raise ValueError("a delta doesn't fit its base")
    wanted, at = number(at)
    out = bytearray()
    while at < len(delta):
        code, at = delta[at], at + 1
        if code & 0x80:
            start = length = 0
            for k in range(4):
                if code >> k & 1:
                    start, at = start | delta[at] << (8 * k), at + 1
            for k in range(3):
                if code >> (4 + k) & 1:
                    length, at = length | delta[at] << (8 * k), at + 1
            length = length or 0x10000
            out += base[start : start + length]
        else:
            out += delta[at : at + code]
            at += code
    if len(out) != wanted:
        raise ValueError("a delta gives another length than it says")
    return bytes(out)


class _Pack:
    """One pack and its index, mapped into memory."""

    def __init__(self, index: Path):
        self.index, self.data = _mapped(index), _mapped(index.with_suffix(".pack"))
        if self.index[:8] != INDEX:
            raise ValueError(f"{index} is no index of version 2")
        self.count = self._word(8 + 4 * 255)
        self.names = 8 + 1024
        self.offsets = self.names + 24 * self.count

    def _word(self, at: int) -> int:
        return int.from_bytes(self.index[at : at + 4], "big")

    def find(self, name: bytes) -> int | None:
        """Where in the pack an object begins, by halving among the names of its first byte."""
        low = self._word(8 + 4 * (name[0] - 1)) if name[0] else 0
        high = self._word(8 + 4 * name[0])
        while low < high:
            middle = (low + high) // 2
            at = self.names + 20 * middle
            held = self.index[at : at + 20]
            if held == name:
                offset = self._word(self.offsets + 4 * middle)
                if offset >> 31:
                    at = self.offsets + 4 * self.count + 8 * (offset & 0x7FFFFFFF)
                    offset = int.from_bytes(self.index[at : at + 8], "big")
                return offset
            low, high = (middle + 1, high) if held < name else (low, middle)
        return None

    def read(self, at: int, other) -> tuple[str, bytes]:
        """Kind and bytes of the object at a place; `other` reads bases that are named, not placed."""
        deltas, place = [], at
        while True:
            begin, byte, at = place, self.data[place], place + 1
            kind = byte >> 4 & 7
            while byte >= 0x80:
                byte, at = self.data[at], at + 1
            if kind == OFFSET_DELTA:
                byte, at = self.data[at], at + 1
                back = byte & 0x7F
                while byte >= 0x80:
                    byte, at = self.data[at], at + 1
                    back = (back + 1) << 7 | byte & 0x7F
                deltas.append(self._unpacked(at))
                place = begin - back
            elif kind == REF_DELTA:
                name = bytes(self.data[at : at + 20])
                deltas.append(self._unpacked(at + 20))
                found, content = other(name.hex())
                break
            else:
                found, content = KINDS[kind], self._unpacked(at)
                break
        for delta in reversed(deltas):
            content = _apply(content, delta)
        return found, content

    def _unpacked(self, at: int) -> bytes:
        unpack, out = zlib.decompressobj(), []
        while not unpack.eof:
            piece = self.data[at : at + 65_536]
            if not piece:
                raise ValueError("a packed object is cut off")
            out.append(unpack.decompress(piece))
            at += len(piece)
        return b"".join(out)


def _mapped(path: Path) -> mmap.mmap:
    with path.open("rb") as file:
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


class Repository:
    """Objects by name, loose or packed."""

    def __init__(self, path: str):
        root = Path("/" + path[5:].lstrip("/") if path.startswith("file:") else path)
        self.root = root / ".git" if (root / ".git").is_dir() else root
        self.packs = [_Pack(p) for p in sorted((self.root / "objects/pack").glob("*.idx"))]
        self.tree = lru_cache(4096)(self._tree)

    def resolve(self, ref: str) -> str:
        """The name of the commit that a ref, or a chain of refs, points to."""
        for _ in range(8):
            found = next((p for p in (self.root / ref, self.root / "refs/heads" / ref, self.root / "refs/tags" / ref) if p.is_file()), None)
            if found is None:
                packed = (self.root / "packed-refs").read_text().splitlines() if (self.root / "packed-refs").exists() else []
                lines = [line.split(" ", 1) for line in packed if line[:1] not in ("#", "^")]
                ref = next((name for name, full in lines if full in (ref, f"refs/heads/{ref}", f"refs/tags/{ref}")), ref)
            else:
                ref = found.read_text().strip().removeprefix("ref: ")
            if len(ref) == 40 and not set(ref) - set("0123456789abcdef"):
                kind, content = self.read(ref)
                if kind == "commit":
                    return ref
                ref = content.split(b"\n", 1)[0].split()[1].decode()  # a tag names its object first
        raise ValueError(f"no commit is named {ref}")

    def read(self, name: str) -> tuple[str, bytes]:
        loose = self.root / "objects" / name[:2] / name[2:]
        if loose.is_file():
            head, _, content = zlib.decompress(loose.read_bytes()).partition(b"\0")
            return head.split()[0].decode(), content
        for pack in self.packs:
            at = pack.find(bytes.fromhex(name))
            if at is not None:
                return pack.read(at, self.read)
        raise ValueError(f"the repository lacks the object {name}")

    def commit(self, name: str) -> tuple[str, list[str], int]:
        """Tree, parents and time of a commit."""
        lines = self.read(name)[1].split(b"\n\n", 1)[0].decode("utf-8", "replace").split("\n")
        fields = [line.split(" ", 1) for line in lines if " " in line]
        time = next(v for k, v in fields if k == "committer").rsplit(" ", 2)[1]
        return next(v for k, v in fields if k == "tree"), [v for k, v in fields if k == "parent"], int(time)

    def _tree(self, name: str) -> dict[bytes, str]:
        content, at, out = self.read(name)[1], 0, {}
        while at < len(content):
            space, end = content.index(b" ", at), content.index(b"\0", at)
            out[content[space + 1 : end]] = content[end + 1 : end + 21].hex()
            at = end + 21
        return out

    def blob_at(self, commit: str, path: str) -> str | None:
        """The name of what a commit holds under a path; None if it holds nothing there."""
        found = self.commit(commit)[0]
        for part in path.encode().split(b"/"):
            found = self.tree(found).get(part) if found else None
        return found

    def commits(self, start: str) -> list[tuple[str, list[str], int]]:
        """All commits that lead to one, oldest first, parents before children."""
        seen, stack = {}, [start]
        while stack:
            name = stack.pop()
            if name not in seen:
                _, parents, time = self.commit(name)
                seen[name] = (parents, time)
                stack += parents
        waits = {name: len(parents) for name, (parents, _) in seen.items()}
        children: dict[str, list[str]] = {}
        for name, (parents, _) in seen.items():
            for parent in parents:
                children.setdefault(parent, []).append(name)
        ready, out = [(seen[n][1], n) for n, w in waits.items() if not w], []
        heapq.heapify(ready)
        while ready:
            time, name = heapq.heappop(ready)
            out.append((name, seen[name][0], time))
            for child in children.get(name, []):
                waits[child] -= 1
                if not waits[child]:
                    heapq.heappush(ready, (seen[child][1], child))
        return out


@dataclass
class Run(InputPartition):
    commits: list[tuple[str, list[str], int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ref = options["path"], options.get("ref", "HEAD")
        self.paths, self.size = options["paths"].split("\n"), int(options.get("taskcommits", 500))

    def partitions(self) -> list[Run]:
        repository = Repository(self.path)
        found = repository.commits(repository.resolve(self.ref))
        return [Run(found[at : at + self.size]) for at in range(0, len(found), self.size)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        repository = Repository(self.path)
        for name, parents, time in partition.commits:
            for path in self.paths:
                blob = repository.blob_at(name, path)
                before = [repository.blob_at(p, path) for p in parents] or [None]
                if blob in before:
                    continue  # what a parent had already
                kind, content = repository.read(blob) if blob else (None, None)
                if kind == "tree":
                    raise ValueError(f"{path} is a folder in {name}")
                row = {"revision": name, "committed": time, "path": path, "blob": blob, "bytes": None if content is None else len(content)}
                row |= {"sha256": None if content is None else hashlib.sha256(content).hexdigest(), "content": content}
                yield pa.RecordBatch.from_pylist([row], _ARROW)


_ARROW = pa.schema([("revision", pa.string()), ("committed", pa.int64()), ("path", pa.string()), ("blob", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())])


class RevisionSource(DataSource):
    """Options: path of the repository; ref; paths (one a line); taskCommits."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_revisions"

    def schema(self) -> str:
        return REVISIONS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_revisions(spark: SparkSession, path: str, paths: list[str], ref: str = "HEAD", task_commits: int = 500) -> DataFrame:
    """(revision, committed, path, blob, bytes, sha256, content) for each commit leading to `ref` that gives a path other contents than all
    its parents have; a path that a commit deletes has null contents. `committed` is in seconds since 1970."""
    ship(spark)
    spark.dataSource.register(RevisionSource)
    options = {"paths": "\n".join(paths), "ref": ref, "taskCommits": str(task_commits)}
    return spark.read.format(RevisionSource.name()).options(**options).option("path", path).load()
