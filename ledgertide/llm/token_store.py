"""Token ids in sorted-string-table shards: prefix-compressed blocks, block index, Bloom filter and footer.

A shard file is

    blocks | index | Bloom filter | footer

Block, compressed with zstd: entries (shared, rest, length as varints; rest of the key; value), where `shared` counts the
bytes that the key has in common with the one before it in the block. Index: for each block, its last key, place and
size. Bloom filter: BLOOM_HASHES bits an id. Footer, of fixed size: places and sizes of the two, counts, crc32 and magic.
Key: a byte that tells null ids, the id with its sign flipped (big-endian, so bytes sort as numbers do), and the row's
number among the shard's rows of equal id. Value: the ids, little-endian, of the width that the footer states.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgertide.llm.common import documents, shared_dir, stored, text_or_empty
from ledgertide.llm.tokens import crc32, encoder, vocabulary_path

BLOCK_BYTES = 1 << 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQQBI8s")
MAGIC = b"LTSST\x00\x00\x01"
_KEY = struct.Struct(">BQI")
_ID_BYTES = 9


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return _KEY.pack(doc_id is not None, ((doc_id or 0) + (1 << 63)) & ((1 << 64) - 1), nth)


def id_of(key: bytes) -> int | None:
    present, number, _ = _KEY.unpack(key)
    return number - (1 << 63) if present else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_places(key: bytes, n_bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % n_bits for i in range(BLOOM_HASHES)]


def _file_system(directory: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder's address and the folder's path in it; Hadoop's names of object stores are understood."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", directory))


class ShardWriter:
    """Writes entries, given in key order, to a binary file that need not seek."""

    def __init__(self, out, width: int = 2):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.n_tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        assert not self.keys or self.keys[-1] < key, "keys must ascend"
        value = ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        place = self.at, len(data)
        self.out.write(data)
        self.at += len(data)
        return place

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.last, *self._write(self.pack.compress(bytes(self.block)))))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for b in _bloom_places(key[:_ID_BYTES], bits):
                bloom[b >> 3] |= 1 << (b & 7)
        i, b = self._write(index), self._write(bytes(bloom))
        self._write(FOOTER.pack(*i, *b, len(self.keys), self.n_tokens, len(self.index), self.width, zlib.crc32(index + bloom), MAGIC))


class Shard:
    """Reads a shard; get() touches the footer, the index, the Bloom filter and the blocks that may hold the id, mostly one."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        end = file.tell()
        file.seek(end - FOOTER.size)
        i_at, i_n, b_at, b_n, self.n_docs, self.n_tokens, n_blocks, self.width, check, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        file.seek(i_at)
        index, self.bloom = file.read(i_n), None
        file.seek(b_at)
        self.bloom = file.read(b_n)
        if zlib.crc32(index + self.bloom) != check:
            raise ValueError("the shard's index is damaged")
        self.last_keys, self.places, at = [], [], 0
        for _ in range(n_blocks):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            self.places.append(struct.unpack_from("<QQ", index, at + n))
            at += n + 16
        self.unpack = zstandard.ZstdDecompressor()

    def _entries(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        self.file.seek(self.places[k][0])
        block, at, key = self.unpack.decompress(self.file.read(self.places[k][1])), 0, b""
        while at < len(block):
            shared, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + rest]
            at += rest
            yield key, np.frombuffer(block, dtype=f"<u{self.width}", count=size // self.width, offset=at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.places)):
            yield from self._entries(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this id: none where the Bloom filter or the index rules it out."""
        key = key_of(doc_id)
        bits, rows = 8 * len(self.bloom), []
        if all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_places(key[:_ID_BYTES], bits)):
            for k in range(bisect_left(self.last_keys, key), len(self.places)):
                for found, ids in self._entries(k):
                    if found[:_ID_BYTES] > key[:_ID_BYTES]:
                        return rows
                    if found[:_ID_BYTES] == key[:_ID_BYTES]:
                        rows.append(ids)
        return rows


def write_shards(docs: DataFrame, directory: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Tokenizes docs into shards in a folder that all executors share; returns a row for each shard.

    Columns: shard, path, first_id, last_id, n_docs, n_tokens. Shards hold ascending ranges of ids, nulls first; rows of
    equal id stand in the order of their texts' hashes, so that they can be dealt out as well. A shard is written under
    a task's own name and then renamed, so a task that is run again replaces it with the same bytes. Ids are integers. Null
    and empty texts are their end id alone; an empty table gives no shards, and columns other than the two named have
    no effect.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer, as keys are sorted by it")
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        store, store_dir = _file_system(directory)
        store.create_dir(store_dir, recursive=True)
        name = f"{store_dir}/shard-{shard:06d}.sst"
        own = f"{name}.{task.taskAttemptId()}"
        encode, writer, last, nth, first = encoder(path), None, (), 0, None
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with store.open_output_stream(own) as out:
            writer = ShardWriter(out, width)
            for batch in batches:
                for k, text in zip(batch.column(0), batch.column(1), strict=True):
                    doc_id = k.as_py()
                    nth = nth + 1 if last == (doc_id,) else 0
                    first = first if last else (doc_id,)
                    last = (doc_id,)
                    writer.add(key_of(doc_id, nth), encode(text.as_py(), end_id))
            writer.close()
        if not last:
            store.delete_file(own)
            return
        store.move(own, name)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "first_id": first[0], "last_id": last[0], "n_docs": len(writer.keys), "n_tokens": writer.n_tokens}], schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return ranged.mapInArrow(run, "shard long, path string, first_id long, last_id long, n_docs long, n_tokens long")


def read_shards(shards: DataFrame, directory: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files; shards as write_shards returns it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    placed = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _file_system(directory)
        for batch in batches:
            for name, base in zip(batch.column("path"), batch.column("base"), strict=True):
                found, start = [], base.as_py()
                with store.open_input_file(name.as_py()) as file:
                    for key, ids in Shard(file):
                        found.append((id_of(key), start, len(ids), crc32(ids)))
                        start += len(ids)
                        if len(found) == 10_000:
                            yield _rows(found)
                            found = []
                if found:
                    yield _rows(found)

    return placed.select("path", "base", "shard").repartition(max(1, shards.count()), "shard").select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids by shard files, read back. Null texts count as empty; repeated rows are stored each by itself."""
    directory = shared_dir(spark, "token-store")
    return read_shards(stored(write_shards(documents(spark, sf_dir), directory), "shards"), directory)
