"""Media columns: content-addressed images in tar shards.

A text's bytes, filled up with zeros to a positive multiple of 64, become the samples of an 8-bit greyscale PNG 64 pixels
wide, which is lossless. A task stores each distinct content once. It appends the images to a tar shard of its own in the
shared folder and returns rows of digest, shard, offset and length; these rows are written as a table, so only shards of
tasks that Spark committed are ever referred to and a task run again leaves at most an unused shard. Readers fetch the
first HEADER bytes of a member for the metadata columns, and the member's range for features.

Defined cases: null and empty text store 64 zero bytes; repeated rows share one member; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, save, slices, table

WIDTH = 64
#: Bytes of a member's start that hold all metadata: signature, IHDR, tEXt with the unpadded length.
HEADER = 128
#: A shard is closed beyond this many bytes.
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBER = "digest binary, shard string, offset long, length long"
READ = (
    "digest binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, width long, height long"
)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode_png(data: bytes) -> bytes:
    payload = pad(data)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    filtered[:, 1:] = rows
    ihdr = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"".join(
        (_SIGNATURE, _chunk(b"IHDR", ihdr), _chunk(b"tEXt", b"bytes\0%d" % len(data)), _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)), _chunk(b"IEND", b""))
    )


def read_header(head: bytes) -> tuple[int, int, int]:
    """width, height and unpadded length, from a member's first bytes alone."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or head[37:41] != b"tEXt":
        raise ValueError("not a member of these shards")
    width, height = struct.unpack(">II", head[16:24])
    (n,) = struct.unpack(">I", head[33:37])
    return width, height, int(head[41 : 41 + n].partition(b"\0")[2])


def decode_png(media: bytes) -> bytes:
    at, packed = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            packed.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, WIDTH + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and edge energy of the samples, and the shares of eight grey levels."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 5, minlength=8)
    edges = int(np.abs(np.diff(x.astype(np.int16))).sum())
    return f"mean={x.mean():.4f};std={x.std():.4f};edges={edges};levels=" + ",".join(map(str, levels))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class _Shard:
    """A tar file written front to back, telling where each member's bytes lie."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.tar"
        fs, path = _filesystem(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at = fs.open_output_stream(path), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.PAX_FORMAT)
        self.out.write(head + data + bytes(-len(data) % tarfile.BLOCKSIZE))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % tarfile.BLOCKSIZE
        return offset

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, digest, shard, offset, length of every row: a task stores each content it meets once, named by its digest, and
    gives equal texts the same place. To be written before it is used."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shard, known = None, {}
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                data = (text or "").encode()
                digest = hashlib.sha256(data).digest()
                if digest not in known:
                    media = encode_png(data)
                    shard = shard or _Shard(folder)
                    known[digest] = (digest, shard.uri, shard.add(digest.hex() + ".png", media), len(media))
                    if shard.at > SHARD_BYTES:
                        shard.close()
                        shard = None
                rows.append(known[digest])
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {MEMBER}")


def read_metadata(members: DataFrame) -> DataFrame:
    """digest, width, height, n_bytes by header-only range reads."""

    def run(batches):
        for b in batches:
            rows = []
            for digest, f, offset, length in _opened(b):
                f.seek(offset)
                rows.append((digest, *read_header(f.read(min(HEADER, length)))))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["digest", "width", "height", "n_bytes"])

    return members.mapInArrow(run, "digest binary, width long, height long, n_bytes long")


def _opened(batch: pa.RecordBatch):
    """Members of a batch with their open shard; a shard stays open while its rows follow each other."""
    name, f = None, None
    try:
        for r in batch.to_pylist():
            if r["shard"] != name:
                if f:
                    f.close()
                fs, path = _filesystem(r["shard"])
                name, f = r["shard"], fs.open_input_file(path)
            yield r["digest"], f, r["offset"], r["length"]
    finally:
        if f:
            f.close()


def read_features(members: DataFrame) -> DataFrame:
    """Metadata from a header-only read, then payload digests and features from the stored bytes of the whole member."""

    def run(batches):
        for b in batches:
            rows = []
            for digest, f, offset, length in _opened(b):
                f.seek(offset)
                width, height, n_bytes = read_header(f.read(min(HEADER, length)))
                f.seek(offset)
                media = f.read(length)
                payload = decode_png(media)
                if hashlib.sha256(payload[:n_bytes]).digest() != digest or len(payload) != width * height:
                    raise ValueError("a member's bytes are not its digest's")
                rows.append(
                    (digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload), width, height)
                )
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return members.mapInArrow(run, READ)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and the members table with one place for each digest. Texts go straight from their scan
    to a shard and are never shuffled; what moves are digests and places. A content that several tasks met has as many
    copies in shards, of which the members table names one."""
    rows = save(write_shards(docs, new_path(docs.sparkSession, "shards")), "members")
    members = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("m")).select("digest", "m.*")
    return rows.select("doc_id", "digest"), members


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its content's digest, shard, offset and length, the metadata that header-only reads fill in, and what
    is computed from the stored bytes."""
    rows, members = store(table(spark, sf_dir, "documents"))
    members = save(members.sortWithinPartitions("shard", "offset"), "contents")
    meta = read_metadata(members).select(F.col("digest").alias("_d"), "width", "height", F.col("n_bytes").alias("_n"))
    read = read_features(members).drop("width", "height").withColumnRenamed("digest", "_digest")
    place = members.select("digest", "shard", "offset", "length")
    known = place.join(meta, place["digest"] == meta["_d"]).join(read, place["digest"] == read["_digest"]).drop("_d", "_n", "_digest")
    columns = "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature width height shard offset length".split()
    return rows.join(known, "digest").select("doc_id", *columns, F.lower(F.hex("digest")).alias("digest"))
