"""Payloads as they came over the wire: packing layers taken off one by one and recorded, and containers written in one fixed form."""

from __future__ import annotations

import bz2
import hashlib
import io
import lzma
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import ship

#: Fixed values of the formats: how a packed payload begins.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd"}
MOST_LAYERS = 8


def _zstd(data: bytes) -> bytes:
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as stream:
        return stream.read()


def _brotli(data: bytes) -> bytes:
    import brotli  # may be absent: it has no magic number and is tried last

    return brotli.decompress(data)


_OPEN: dict[str, Callable[[bytes], bytes]] = {"gzip": lambda d: _all_members(d), "bzip2": bz2.decompress, "xz": lzma.decompress, "zstd": _zstd, "zlib": zlib.decompress, "brotli": _brotli}


def _all_members(data: bytes) -> bytes:
    """A gzip payload, which may be several one after the other; what follows the last one has to be nothing but zeros."""
    out = []
    while data.startswith(MAGIC["gzip"]):
        unpack = zlib.decompressobj(31)
        out.append(unpack.decompress(data) + unpack.flush())
        if not unpack.eof:
            raise zlib.error("the payload is cut off")
        data = unpack.unused_data
    if data.strip(b"\0"):
        raise zlib.error("something else follows the payload")
    return b"".join(out)


def is_format(data: bytes, expected: str) -> bool:
    """Whether a payload is what was asked for: "zip", "json", or text that begins with `expected` (after a byte order mark)."""
    if expected == "zip":
        return zipfile.is_zipfile(io.BytesIO(data))
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return False
    return text.lstrip()[:1] in ("{", "[") if expected == "json" else text.startswith(expected)


def decoded(data: bytes, expected: str) -> tuple[bytes, list[str]]:
    """The payload without its packing, and the layers that were taken off, outermost first; fails if it never is what was asked for."""
    layers: list[str] = []
    while not is_format(data, expected):
        if len(layers) == MOST_LAYERS:
            raise ValueError(f"more than {MOST_LAYERS} layers")
        known = [name for name, magic in MAGIC.items() if data.startswith(magic)]
        for name in known or ("zlib", "brotli"):
            try:
                data = _OPEN[name](data)
                layers.append(name)
                break
            except ImportError:
                continue
            except Exception as problem:
                if known:
                    raise ValueError(f"{'/'.join([*layers, name])}: {problem}") from problem
        else:
            raise ValueError(f"after {'/'.join(layers) or 'no layer'} the payload is not the one expected")
    return data, layers


def decode_transport(df: DataFrame, content: str, expected: str) -> DataFrame:
    """`df` with column `content` unpacked, and columns layers ("gzip/brotli", "" if there were none), sha256 and error.

    A payload that can't be unpacked to what was asked for, or is null, has null content and says why. Payloads are held one by one.
    """
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != content]
    schema = StructType([*kept, StructField(content, BinaryType()), *(StructField(c, StringType()) for c in ("layers", "sha256", "error"))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in range(part.num_rows):
                data = part.column(part.schema.get_field_index(content))[row].as_py()
                try:
                    if data is None:
                        raise ValueError("no payload")
                    data, layers = decoded(data, expected)
                    made = [data, "/".join(layers), hashlib.sha256(data).hexdigest(), None]
                except ValueError as problem:
                    made = [None, None, None, str(problem)]
                one = part.slice(row, 1)
                columns = [one.column(one.schema.get_field_index(f.name)) for f in kept]
                columns += [pa.array([v], t) for v, t in zip(made, (pa.binary(), pa.string(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)


def normalised_zip(data: bytes) -> bytes:
    """The same members in order of name, without times, comments, attributes or extra fields: equal contents give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as source, zipfile.ZipFile(out, "w") as target:
        for info in sorted((i for i in source.infolist() if not i.is_dir()), key=lambda i: i.filename):
            fresh = zipfile.ZipInfo(info.filename, (1980, 1, 1, 0, 0, 0))
            fresh.compress_type, fresh.external_attr, fresh.create_system = zipfile.ZIP_DEFLATED, 0o644 << 16, 3
            target.writestr(fresh, source.read(info), compresslevel=9)
    return out.getvalue()
