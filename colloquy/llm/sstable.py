"""Token identifiers in sorted-string-table shards.

Documents are dealt by ranges of their identifier; each task sorts its range, encodes it and writes one shard:

    blocks of entries | Bloom filter | block index | footer

An entry holds how many leading key bytes it shares with the entry before it in its block, the rest of
the key, and the document's tokens; a block is compressed as a whole. The sparse index has each block's
first key and place, so a lookup is a Bloom test, a binary search, and the decoding of a block. A shard is
written under a name of the task attempt's own and moved into place when complete, so a lost or repeated task
leaves either the whole shard or none.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder
from .encoding import encoder, slices

#: Raw bytes of a block, bits of the Bloom filter per key and probes, and the ends of a shard.
BLOCK_BYTES, BLOOM_BITS, BLOOM_PROBES, MAGIC = 256_000, 10, 7, b"SSTOKEN1"
#: Footer: places and lengths of Bloom filter and index, documents, tokens, bytes per token, magic.
FOOTER = struct.Struct("<QQQQQQB8s")
END_ID = 1
#: Bytes of text and documents of a shard, about; a writer holds a shard's keys for its Bloom filter.
SHARD_BYTES, SHARD_DOCS = 512 << 20, 1_000_000


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes in the order of the identifiers, null first."""
    return bytes(9) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + n * b) % bits for n in range(BLOOM_PROBES)]


class ShardWriter:
    """Writes entries, given in ascending key order, to a binary stream."""

    def __init__(self, stream, token_bytes: int = 4, block_bytes: int = BLOCK_BYTES):
        self.stream, self.kind, self.most = stream, np.dtype(f"<u{token_bytes}"), block_bytes
        self.at = self.docs = self.tokens = self.size = 0
        self.block, self.index, self.keys = [], [], []
        self.first = self.before = b""
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype(self.kind).tobytes()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.before[shared]:
                shared += 1
        else:
            self.first = key
        entry = struct.pack("<BBI", shared, len(key) - shared, len(ids)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.before = key
        self.docs += 1
        self.tokens += len(ids)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= self.most:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = self.pack.compress(b"".join(self.block))
            self.index.append(struct.pack("<9sQI", self.first, self.at, len(packed)))
            self.stream.write(packed)
            self.at += len(packed)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.stream.write(bloom.tobytes() + index)
        self.stream.write(FOOTER.pack(self.at, bits, self.at + len(bloom), len(index), self.docs, self.tokens, self.kind.itemsize, MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary stream of known size."""

    def __init__(self, stream, size: int):
        self.stream = stream
        at, self.bits, index_at, index_size, self.docs, self.tokens, width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.kind = np.dtype(f"<u{width}")
        self.bloom = np.frombuffer(self._read(at, (self.bits + 7) // 8), np.uint8)
        self.index = list(struct.iter_unpack("<9sQI", self._read(index_at, index_size)))

    def _read(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def _block(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size = self.index[n]
        raw = zstandard.ZstdDecompressor().decompress(self._read(at, size))
        key, p = b"", 0
        while p < len(raw):
            shared, rest, count = struct.unpack_from("<BBI", raw, p)
            p += 6
            key = key[:shared] + raw[p : p + rest]
            p += rest
            yield key, np.frombuffer(raw, self.kind, count, p)
            p += count * self.kind.itemsize

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for n in range(len(self.index)):
            for key, ids in self._block(n):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token lists stored under an identifier, none if it isn't there."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return []
        firsts = [x[0] for x in self.index]
        n = max(0, bisect_right(firsts, key) - 1)
        while n and firsts[n] == key:  # an identifier's rows may fill whole blocks
            n -= 1
        out = []
        while n < len(firsts) and firsts[n] <= key:
            out += [ids for k, ids in self._block(n) if k == key]
            n += 1
        return out


def write_shards(
    docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """Encode every text of docs (doc_id, text) with a tokenizers file that lowers case, append end_id, write shards.

    The number of shards follows from the texts' bytes and number, so shards keep their size however large the table is; there
    is one for each core at least. Returns the manifest: (shard, path, n_docs, n_tokens, base), base the tokens in the shards before. Null texts
    count as empty; a null doc_id sorts first; repeated identifiers are stored in a row; other columns
    are ignored; an empty table gives no shard. The manifest has a row per shard, not per document.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).head()
    parts = max(spark.sparkContext.defaultParallelism, -(-(size or 0) // shard_bytes), -(-n // shard_docs))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        tokens = encoder(path, True)
        width = 2 if max(tokens.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        own, final = f"{root}/writing-{uuid.uuid4().hex}", f"{root}/shard-{shard:06d}.sst"
        end = np.array([end_id], "<u4")
        writer = None
        with store.open_output_stream(own) as stream:
            writer = ShardWriter(stream, width)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for part in slices(texts):
                    for doc_id, found in zip(ids[part], tokens.encode(texts[part]), strict=True):
                        writer.add(key_of(doc_id), np.concatenate([np.frombuffer(found, "<u4"), end]))
            writer.close()
        if writer.docs:
            store.move(own, final)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"shard-{shard:06d}.sst"], "n_docs": [writer.docs], "n_tokens": [writer.tokens]}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
        else:
            store.delete_file(own)

    shards = sorted(dealt.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long").collect())
    bases = np.concatenate(([0], np.cumsum([s["n_tokens"] for s in shards]))).tolist()
    return spark.createDataFrame([(s["shard"], f"{folder}/{s['path']}", s["n_docs"], s["n_tokens"], b) for s, b in zip(shards, bases, strict=False)], "shard int, path string, n_docs long, n_tokens long, base long")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the shards; ids are little-endian unsigned 32-bit integers."""
    from pyarrow import fs

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as stream:
                    out, held = [], 0
                    for doc_id, ids in ShardReader(stream, stream.size()):
                        out.append((doc_id, base, ids.astype("<u4").tobytes()))
                        base += len(ids)
                        held += 4 * len(ids)
                        if held > 8_000_000:
                            yield _rows(out)
                            out, held = [], 0
                    if out:
                        yield _rows(out)

    parts = max(1, min(manifest.count(), 100_000))
    return manifest.select("path", "base").repartition(parts).mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])
