"""Media columns: content-addressed payloads in tar shards, header-only range reads for metadata.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of an 8-bit grey PNG of width
64.  Every task writes the payloads it has not yet written into its own tar shard under their digest; rows carry
digest, shard, offset and length.  The first place of a digest, over all shards, is the one rows point to.  Metadata
columns are filled in a pass that reads only the 29 header bytes of a member; features come from the stored bytes, once per
digest.

Cases: null or empty text: 64 zero bytes.  Null doc_id and repeated rows: kept, equal texts share one payload.  Empty
table: no rows.  Very long text: one larger member.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, id_and_text, materialize, new_dir, read_table, rows_to_batch, small_batches

WIDTH = 64
SHARD_BYTES = 256 << 20
#: PNG signature (fixed value).
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """Grey, 8 bits a sample, one payload byte per sample."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), level)) + _part(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """width, height, bit depth from the first 29 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack_from(">IIB", head, 16)
    return width, height, depth


def from_png(data: bytes) -> bytes:
    width, height, _ = read_header(data)
    at, body = 8, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(width: int, height: int, payload: bytes) -> str:
    v = np.frombuffer(payload, np.uint8)
    n = np.bincount(v, minlength=256)
    p = n[n > 0] / len(v)
    return f"{width}x{height} mean={v.mean():.4f} sd={v.std():.4f} entropy={max(0.0, -(p * np.log2(p)).sum()):.4f}"


def write_shards(docs: DataFrame, level: int = 6) -> DataFrame:
    """doc_id, n_bytes, digest, shard, at, size: one row per document."""
    out_dir = new_dir(docs.sparkSession, "media")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("at", pa.int64()), ("size", pa.int64())])

    def run(batches):
        fs, root = filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        shard, name, at, known = None, "", 0, {}
        try:
            for rows in small_batches(batches):
                out = []
                for d, text in rows:
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        if shard is None or at > SHARD_BYTES:
                            if shard is not None:
                                shard.write(b"\0" * 1024)
                                shard.close()
                            name, at, known = f"{uuid.uuid4().hex}.tar", 0, {}
                            shard = fs.open_output_stream(f"{root}/{name}")
                        data = to_png(payload, level)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(data)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        shard.write(head + data + b"\0" * (-len(data) % 512))
                        known[digest] = (f"{out_dir}/{name}", at + len(head), len(data))
                        at += len(head) + len(data) + -len(data) % 512
                    out.append((d, len((text or "").encode("utf-8")), digest, *known[digest]))
                yield rows_to_batch(out, schema)
        finally:
            if shard is not None:
                shard.write(b"\0" * 1024)
                shard.close()

    return materialize(id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, at long, size long"), "media-rows")


def places(rows: DataFrame) -> DataFrame:
    """digest and its first place over all shards; copies in other shards are never read."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "at", "size")).alias("p")).select("digest", "p.shard", "p.at", "p.size")


class Members:
    """Range reads of members, by shard; the last shard stays open."""

    def __init__(self):
        self.name, self.f = None, None

    def read(self, shard: str, at: int, size: int) -> bytes:
        if shard != self.name:
            self.close()
            fs, path = filesystem(shard)
            self.name, self.f = shard, fs.open_input_file(path)
        return self.f.read_at(size, at)

    def close(self) -> None:
        if self.f is not None:
            self.f.close()


def _in_order(located: DataFrame) -> DataFrame:
    """Members of a shard side by side, a task per 4 MB of it."""
    return located.select("digest", "shard", "at", "size").repartition("shard", F.floor(F.col("at") / (4 << 20))).sortWithinPartitions("shard", "at")


PLACE = [("digest", pa.string()), ("shard", pa.string()), ("at", pa.int64()), ("size", pa.int64())]
METADATA = [("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32())]


def read_metadata(located: DataFrame) -> DataFrame:
    """digest, shard, at, size, and width, height, depth: only the 29 header bytes of every member are read."""
    schema = pa.schema(PLACE + METADATA)

    def run(batches):
        members = Members()
        for rows in small_batches(batches, rows=512):
            yield rows_to_batch([(*r, *read_header(members.read(r[1], r[2], 29))) for r in rows], schema)
        members.close()

    return located.select("digest", "shard", "at", "size").mapInArrow(run, "digest string, shard string, at long, size long, width int, height int, depth int")


def read_media(known: DataFrame) -> DataFrame:
    """The digest and metadata, and payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: from the
    whole stored bytes.  Raises where they are not what the metadata or the digest say."""
    schema = pa.schema([PLACE[0], *METADATA, ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        members = Members()
        for rows in small_batches(batches, rows=512):
            out = []
            for digest, shard, at, size, width, height, depth in rows:
                media = members.read(shard, at, size)
                payload = from_png(media)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest or len(payload) != width * height:
                    raise ValueError(f"stored bytes of {digest} differ")
                out.append((digest, width, height, depth, len(payload), sha, zlib.crc32(payload[-64:]), size, hashlib.sha256(media).hexdigest(), feature_of(width, height, payload)))
            yield rows_to_batch(out, schema)
        members.close()

    ddl = "digest string, width int, height int, depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return known.select("digest", "shard", "at", "size", "width", "height", "depth").mapInArrow(run, ddl)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and of the payload its metadata (from headers) and features (from the stored bytes)."""
    rows = write_shards(docs)
    read = materialize(read_media(read_metadata(_in_order(places(rows)))), "media-features")
    return rows.select("doc_id", "n_bytes", "digest").join(read, "digest").drop("digest")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))
