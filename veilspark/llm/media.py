"""Operator 10: media columns over content-addressed payloads in tar shards.

A text becomes a payload of 8-bit grey samples (its UTF-8, then zeros up to a positive multiple of 64), stored
as a PNG of 64 samples a row, so without loss. PNGs go into tar shards named by the digest of their members;
within a shard each content stands once. Rows carry shard, digest, offset and length. Readers then fetch ranges:
the first bytes of a member for its dimensions, the whole member for the samples.

Null text counts as empty (one row of zeros). Equal texts give equal values. Repeated rows stay, other columns
do not matter, an empty table gives an empty one. A shard that a lost task wrote is written again under the
same name, since the name follows from the content.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.common import shared_dir, written

WIDTH = 64
HEAD_BYTES = 33  # PNG signature and header chunk
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SHARD_BYTES = 64 << 20
INDEX = "digest string, shard string, offset bigint, length bigint, n_bytes bigint"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes) -> bytes:
    """8-bit grey PNG, WIDTH samples a row, filter none."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 5)) + _chunk(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int]:
    """Width and height from the first HEAD_BYTES of a PNG."""
    if len(head) < HEAD_BYTES or head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">II", head[16:24])


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG that ``encode_png`` wrote; damaged chunks raise ValueError."""
    width, height = png_size(data[:HEAD_BYTES])
    at, packed = 8, b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unexpected row filter")
    return rows[:, 1:].tobytes()


@lru_cache(maxsize=8)
def _files(uri: str):
    """A file system and path for any URI that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shard:
    """A tar file under construction in memory, at most SHARD_BYTES and one member."""

    def __init__(self):
        self.out = io.BytesIO()
        self.tar = tarfile.open(fileobj=self.out, mode="w", format=tarfile.USTAR_FORMAT)
        self.members: dict[str, tuple[int, int]] = {}
        self.name = hashlib.sha256()

    def add(self, digest: str, data: bytes) -> None:
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        self.tar.addfile(info, io.BytesIO(data))
        self.members[digest] = (self.tar.offset - len(data) - (-len(data) % 512), len(data))
        self.name.update(digest.encode())

    def save(self, root: str) -> str:
        self.tar.close()
        fs, base = _files(root)
        fs.create_dir(base, recursive=True)
        name = f"{self.name.hexdigest()}.tar"
        part = f"{base}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(self.out.getbuffer())
        fs.move(part, f"{base}/{name}")
        return name


def store(docs: DataFrame, root: str, id_column: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every text's payload into tar shards under ``root``; per row: id and its index columns."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        shard, waiting = _Shard(), []

        def close():
            name = shard.save(root)
            rows = [(i, d, name, *shard.members[d], n) for i, d, n in waiting]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        names = [id_column, "digest", "shard", "offset", "length", "n_bytes"]
        types = None
        for batch in batches:
            types = [batch.column(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                samples = payload(text)
                data = None
                key = hashlib.sha256(samples).digest()
                digest = seen.get(key)
                if digest is None or digest not in shard.members:
                    data = encode_png(samples)
                    digest = seen[key] = hashlib.sha256(data).hexdigest()
                    shard.add(digest, data)
                waiting.append((i, digest, len(text.encode("utf-8"))))
                if shard.out.tell() >= shard_bytes:
                    yield close()
                    shard, waiting = _Shard(), []
                    seen.clear()
        if waiting:
            yield close()

    seen: dict[bytes, str] = {}
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {id_type}, {INDEX}")


def read_columns(index: DataFrame, root: str, id_column: str = "doc_id") -> DataFrame:
    """Fill media columns from the stored bytes: dimensions from header ranges, the rest from whole members."""
    id_type = index.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int"

    def run(batches):
        fs, base = _files(root)
        held: tuple[str, object] = ("", None)
        for batch in batches:
            rows = []
            columns = [c.to_pylist() for c in batch.columns]
            for i, digest, name, offset, length, n_bytes in zip(*columns):
                if held[0] != name:
                    if held[1] is not None:
                        held[1].close()
                    held = (name, fs.open_input_file(f"{base}/{name}"))
                source = held[1]
                width, height = png_size(source.read_at(HEAD_BYTES, offset))
                data = source.read_at(length, offset)
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{name} at {offset}: the stored bytes do not match their digest")
                samples = decode_png(data)
                grey = np.frombuffer(samples, dtype=np.uint8)
                sums = np.bincount(grey >> 5, minlength=8)
                feature = f"{width}x{height}:" + ",".join(map(str, sums)) + f":{int(grey.sum(dtype=np.int64))}"
                rows.append((i, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), digest, feature, width, height))
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 10, types)], names=names)

    return index.select(id_column, "digest", "shard", "offset", "length", "n_bytes").mapInArrow(run, schema)


def read_headers(index: DataFrame, root: str) -> DataFrame:
    """Only the dimensions: HEAD_BYTES are read of each distinct member."""

    def run(batches):
        fs, base = _files(root)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            sizes = []
            for name, offset in zip(columns[1], columns[2]):
                with fs.open_input_file(f"{base}/{name}") as f:
                    sizes.append(png_size(f.read_at(HEAD_BYTES, offset)))
            widths, heights = zip(*sizes) if sizes else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(widths, pa.int32()), pa.array(heights, pa.int32())], names=["digest", "width", "height"])

    return index.select("digest", "shard", "offset").dropDuplicates(["digest"]).mapInArrow(run, "digest string, width int, height int")


def media_columns(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Store and read back: shards go to a folder of their own in the session's shared folder."""
    root = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    index = written(store(docs, root, id_column), "media-index")
    return read_columns(index, root, id_column)
