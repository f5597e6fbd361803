"""Token ids in sorted-string-table shards.

A shard is one file, in this order:

* data blocks: entries ordered by key, each ``varint shared, varint rest, varint n, rest of the key,
  n bytes of value``. ``shared`` is the number of bytes the key shares with the one before it in the
  block; the first of a block shares none. A block ends with the crc32 of what precedes it.
* Bloom filter: ``u32 hashes, u64 bits``, then the bits.
* block index, sparse: per block its last key (``varint n, n bytes``), then varints: offset, length,
  entries before it in the shard, ids before it in the shard.
* footer of 64 bytes: offset and length of filter and index, entries, ids, bytes per id, magic.

A key is one byte (0: no identifier, 1: some) and the identifier as 8 bytes, big-endian with the
sign bit turned, so that bytes order as identifiers do. Keys may repeat. A value is the ids of one
document, little-endian.
"""

from __future__ import annotations

import bisect
import math
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.llm.common import cut, pick, rows_of, shared_dir
from assaymill.llm.tokens import encoder, vocabulary

MAGIC = b"AMSSTBL1"
FOOTER = struct.Struct("<QQQQQQQ8s")
BLOCK_BYTES = 32_768
SHARD_DOCS = 4096
SHARD_BYTES = 128 << 20
#: Ranges of doc_id at most: range partitioning samples on the driver in proportion to them. Larger ranges
#: give several shards each.
MOST_PARTS = 20_000
BITS_PER_KEY = 10
END_ID = 2
VOCABULARY = "word_bpe_49k.json"

MANIFEST = "part long, seq long, path string, n_docs long, n_ids long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, bits: int, hashes: int, data: bytearray | bytes):
        self.bits, self.hashes, self.data = bits, hashes, data

    @classmethod
    def of(cls, keys: list[int], bits_per_key: int) -> Bloom:
        """keys: 128-bit hashes."""
        bits = max(64, len(keys) * bits_per_key)
        made = cls(bits, max(1, round(bits_per_key * math.log(2))), bytearray((bits + 7) // 8))
        for key in keys:
            for bit in made.places(key):
                made.data[bit >> 3] |= 1 << (bit & 7)
        return made

    def places(self, key: int) -> Iterator[int]:
        low, high = key & (1 << 64) - 1, key >> 64 | 1
        return ((low + i * high) % self.bits for i in range(self.hashes))

    def __contains__(self, key: bytes) -> bool:
        return all(self.data[b >> 3] >> (b & 7) & 1 for b in self.places(xxhash.xxh3_128_intdigest(key)))


class Writer:
    """Writes one shard to a binary stream; entries must come in the order of their keys."""

    def __init__(self, stream, id_bytes: int, block_bytes: int = BLOCK_BYTES, bits_per_key: int = BITS_PER_KEY):
        self.stream, self.id_bytes, self.block_bytes, self.bits_per_key = stream, id_bytes, block_bytes, bits_per_key
        self.block, self.last, self.at, self.entries, self.ids = bytearray(), b"", 0, 0, 0
        self.before = (0, 0)
        self.index = bytearray()
        self.hashes: list[int] = []

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must come in order")
        if len(self.block) >= self.block_bytes:
            self._end_block()
        shared = 0
        if self.block:
            for a, b in zip(key, self.last, strict=False):
                if a != b:
                    break
                shared += 1
        else:
            self.before = (self.entries, self.ids)
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        if not self.hashes or key != self.last:
            self.hashes.append(xxhash.xxh3_128_intdigest(key))
        self.last = key
        self.entries += 1
        self.ids += len(value) // self.id_bytes

    def _end_block(self) -> None:
        if not self.block:
            return
        self.block += struct.pack("<I", zlib.crc32(self.block))
        put_varint(self.index, len(self.last))
        self.index += self.last
        for n in (self.at, len(self.block), *self.before):
            put_varint(self.index, n)
        self.stream.write(bytes(self.block))
        self.at += len(self.block)
        self.block = bytearray()

    def finish(self) -> None:
        self._end_block()
        bloom = Bloom.of(self.hashes, self.bits_per_key)
        filter_ = struct.pack("<IQ", bloom.hashes, bloom.bits) + bytes(bloom.data)
        self.stream.write(filter_)
        self.stream.write(bytes(self.index))
        self.stream.write(
            FOOTER.pack(
                self.at, len(filter_), self.at + len(filter_), len(self.index),
                self.entries, self.ids, self.id_bytes, MAGIC,
            )
        )


class Reader:
    """Looks documents up in a shard, or reads it through. source: bytes, or a seekable file."""

    def __init__(self, source):
        if isinstance(source, bytes | bytearray | memoryview):
            source = pa.BufferReader(source)
        self.file = source
        end = source.seek(0, 2)
        at, n, index_at, index_n, self.entries, self.ids, self.id_bytes, magic = FOOTER.unpack(
            self._read(end - FOOTER.size, FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a shard")
        filter_ = self._read(at, n)
        hashes, bits = struct.unpack_from("<IQ", filter_)
        self.bloom = Bloom(bits, hashes, filter_[12:])
        self.lasts, self.blocks = [], []
        index, at = self._read(index_at, index_n), 0
        while at < len(index):
            size, at = get_varint(index, at)
            self.lasts.append(index[at : at + size])
            at += size
            block = []
            for _ in range(4):
                value, at = get_varint(index, at)
                block.append(value)
            self.blocks.append(tuple(block))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return bytes(self.file.read(n))

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        offset, size, _, _ = self.blocks[i]
        data = self._read(offset, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < size - 4:
            shared, at = get_varint(data, at)
            rest, at = get_varint(data, at)
            n, at = get_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def array(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.id_bytes}").astype("<u4")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier."""
        key = key_of(doc_id)
        if key not in self.bloom:
            return []
        out = []
        for i in range(bisect.bisect_left(self.lasts, key), len(self.blocks)):
            for k, value in self._block(i):
                if k == key:
                    out.append(self.array(value))
                elif k > key:
                    return out
        return out

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Identifier, ids of the shard before it, and its ids, for every document in order."""
        for i, (_, _, _, before) in enumerate(self.blocks):
            for key, value in self._block(i):
                ids = self.array(value)
                yield doc_of(key), before, ids
                before += len(ids)


def file_system(place: str):
    """The file system of a folder and its path there; place: a URI, or a path of this machine."""
    from pyarrow import fs

    if place.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(place).path
    return fs.FileSystem.from_uri(place.replace("s3a://", "s3://", 1)) if "://" in place else (fs.LocalFileSystem(), place)


def qualified(spark, place: str) -> str:
    """The folder as a URI of the file system that Spark itself would take for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_shards(
    docs: DataFrame,
    place: str,
    vocabulary_path: str | None = None,
    end_id: int = END_ID,
    shard_docs: int = SHARD_DOCS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Writes every row of ``docs`` (doc_id, text) to shards under ``place``; returns the manifest.

    One manifest row per shard: part and seq (their order is that of doc_id), path, n_docs, n_ids.
    A shard is written under a name of its own attempt and then renamed, so a task that runs twice
    leaves one whole file; the manifest names no other. A shard ends after ``shard_docs`` documents or
    ``shard_bytes``. A null or empty text is the end id alone, a null doc_id comes first, rows that
    repeat are all kept (ties in doc_id go by the text's hash, then the place in the input), an empty
    table gives no shard, other columns are ignored. Ranges part rows of one doc_id, and equal rows,
    too, so many of these are no hot range. ``place`` must be a folder that all executors reach.
    """
    path = vocabulary_path or vocabulary(VOCABULARY)
    rows = pick(docs, doc_id="long", text="string")
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    parts = max(1, min(MOST_PARTS, math.ceil(rows.count() / shard_docs)))
    order = [F.asc_nulls_first("doc_id"), "tie", "row"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(path)
        end = make.pack([end_id])
        fs, folder = file_system(place)
        done, seq, open_ = [], 0, None

        def close() -> None:
            nonlocal open_, seq
            writer, stream, part, trial = open_
            writer.finish()
            stream.close()
            final = f"{folder}/part-{part:06d}-{seq:04d}.sst"
            fs.move(trial, final)
            done.append((part, seq, final, writer.entries, writer.ids))
            seq += 1
            open_ = None

        for batch in batches:
            for doc_id, text, part in rows_of(batch, "doc_id", "text", "part"):
                if open_ is None:
                    fs.create_dir(folder, recursive=True)
                    trial = f"{folder}/_trial-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(trial)
                    open_ = (Writer(stream, make.width), stream, part, trial)
                open_[0].add(key_of(doc_id), make.coded(text) + end)
                if open_[0].at >= shard_bytes or open_[0].entries >= 2 * shard_docs:
                    close()
        if open_ is not None:
            close()
        if done:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["part", "seq", "path", "n_docs", "n_ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names
            )

    manifest = cut(ordered.mapInArrow(write, MANIFEST))
    drop_trials(place)
    return manifest


def drop_trials(place: str) -> None:
    """Removes what attempts that failed have left in the folder; no shard is among it."""
    from pyarrow.fs import FileSelector

    fs, folder = file_system(place)
    for found in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
        if found.base_name.startswith("_trial-"):
            fs.delete_file(found.path)


def read_shards(manifest: DataFrame, place: str) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), ids (binary,
    little-endian unsigned 32-bit)."""
    # Parts have a bound, so one task can number them; the shards of a part are few.
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"), F.count("*").alias("shards"))
    before = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sums = cut(sums.select("part", F.coalesce(before, F.lit(0)).alias("first"), "shards"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    shards = manifest.join(F.broadcast(sums.select("part", "first")), "part")
    shards = shards.select("path", (F.col("first") + F.coalesce(inside, F.lit(0))).alias("before"))
    # A stated number of tasks: Spark would join partitions as small as these into one.
    tasks = max(1, min(MOST_PARTS, sums.agg(F.sum("shards")).head()[0] or 0))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(place)

        def batch_of(out: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["doc_id", "start", "ids"],
            )

        for batch in batches:
            for path, offset in rows_of(batch, "path", "before"):
                out, held = [], 0
                with fs.open_input_file(path) as file:
                    for doc_id, start, ids in Reader(file).scan():
                        out.append((doc_id, offset + start, ids.tobytes()))
                        held += 4 * len(ids)
                        if held >= 1 << 22:
                            yield batch_of(out)
                            out, held = [], 0
                if out:
                    yield batch_of(out)

    return shards.repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, ids binary")


def new_place(spark, name: str) -> str:
    """A folder of its own under the shared one, as a URI."""
    return qualified(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def op9_sstable_roundtrip(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of all of ``documents``, written to shards and read back from them."""
    place = new_place(spark, "sstable")
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), place)
    return read_shards(manifest, place).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
