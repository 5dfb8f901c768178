"""Token ids in sorted-string-table files.

A file holds entries in ascending key order: data blocks with prefix-compressed keys
(a full key every RESTART entries), a sparse index with the last key of each block, a
Bloom filter over the keys, and a footer that tells where these are. A lookup asks the
filter, finds the block by binary search in the index and scans one block.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import new_path, table, written
from .tokens import END_ID, VOCABULARY, encode_with_end

MAGIC = b"MSSTBL01"
BLOCK = 64 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: A writer starts a new file beyond so many bytes; a range of keys takes about so many bytes of text, by a sample of one in UNIT bytes.
FILE_BYTES = 256 << 20
RANGE_BYTES = 64 << 20
UNIT = 1 / 1024  # of a range
_FOOTER = struct.Struct("<QQQQQQI8s")
_ENTRY = struct.Struct("<BBI")


def key_bytes(doc_id: int) -> bytes:
    """Eight bytes whose byte order is the order of the integers."""
    return ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def key_int(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = tk.mix(keys.astype(np.uint64))
    g = tk.mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (h[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * g[:, None]) % np.uint64(bits)


class Writer:
    """Appends entries in key order to a binary stream; ``finish`` writes index, filter and footer."""

    def __init__(self, out):
        self.out, self.at, self.block, self.index, self.keys = out, 0, bytearray(), [], []
        self.last, self.in_block, self.ids = b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last, self.in_block = key, self.in_block + 1
        self.keys.append(key_int(key))
        self.ids += len(value)
        if len(self.block) >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.in_block:
            self.index.append((self.last, self.at, len(self.block), zlib.crc32(self.block)))
            self._put(bytes(self.block))
            self.block, self.in_block = bytearray(), 0

    def finish(self) -> int:
        self._flush()
        index_at = self.at
        self._put(b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQI", o, n, c) for k, o, n, c in self.index))
        bloom_at = self.at
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 64) * 64)
        cells = np.zeros(bits, np.uint8)
        for k in range(0, len(self.keys), 1 << 16):
            cells[_bloom_places(np.array(self.keys[k : k + (1 << 16)], np.int64), bits).ravel()] = 1
        bloom = np.packbits(cells).tobytes()
        self._put(bloom)
        self._put(_FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(bloom), len(self.keys), self.ids, zlib.crc32(bloom), MAGIC))
        return self.at


class Table:
    """Reads a file of ``Writer``: ``scan()`` in key order, ``get(doc_id)`` by filter, index and one block."""

    def __init__(self, source):
        self.file = source
        size = source.size()
        at, n, b_at, b_n, self.count, self.value_bytes, crc, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of this format")
        raw, self.last, self.blocks, p = self._read(at, n), [], [], 0
        while p < len(raw):
            k = raw[p]
            self.last.append(raw[p + 1 : p + 1 + k])
            self.blocks.append(struct.unpack_from("<QQI", raw, p + 1 + k))
            p += 1 + k + 20
        bloom = self._read(b_at, b_n)
        if zlib.crc32(bloom) != crc:
            raise ValueError("damaged filter")
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int):
        at, n, crc = self.blocks[k]
        raw = self._read(at, n)
        if zlib.crc32(raw) != crc:
            raise ValueError("damaged block")
        p, key = 0, b""
        while p < n:
            shared, rest, size = _ENTRY.unpack_from(raw, p)
            p += _ENTRY.size
            key = key[:shared] + raw[p : p + rest]
            p += rest
            yield key, raw[p : p + size]
            p += size

    def scan(self):
        for k in range(len(self.blocks)):
            yield from self._block(k)

    def get(self, doc_id: int) -> list[bytes]:
        """The values of a key, none if it is absent."""
        if not self.count or not self.bloom[_bloom_places(np.array([doc_id], np.int64), len(self.bloom))].all():
            return []
        key, out = key_bytes(doc_id), []
        for k in range(bisect.bisect_left(self.last, key), len(self.blocks)):
            for got, value in self._block(k):
                if got == key:
                    out.append(value)
                elif got > key:
                    return out
        return out


def _open_out(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def open_table(uri: str) -> Table:
    system, path = fs.FileSystem.from_uri(uri)
    return Table(system.open_input_file(path))


def _encode(edges: list[int], vocabulary: str, end_id: int):
    cuts = np.array(edges, np.int64)

    def run(it):
        for batch in it:
            for b in tk.pieces(batch, "text"):
                data, offs = tk.buffers(b.column("text"))
                ids, first = encode_with_end(data, offs, vocabulary, end_id)
                doc = np.asarray(b.column("doc_id"))
                raw = ids.astype("<u2") if ids.max(initial=0) < 65536 else ids
                if raw.itemsize != 2:
                    raise ValueError("this file format holds ids below 65,536")
                values = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer((first * 2).astype(np.int64)), pa.py_buffer(raw)])
                shard = np.searchsorted(cuts, doc, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), b.column("doc_id"), values.cast(pa.binary())], ["shard", "doc_id", "ids"])

    return run


def _write(folder: str):
    def run(it):
        out = writer = path = None
        shard, first = -1, 0
        made = []

        def close():
            size = writer.finish()
            out.close()
            made.append((shard, first, key_int(writer.last), path, len(writer.keys), writer.ids // 2, size))

        for batch in it:
            for s, d, v in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if writer is not None and (s != shard or writer.at > FILE_BYTES):
                    close()
                    writer = None
                if writer is None:
                    shard, first, path = s, d, f"{folder}/{s:05d}-{uuid.uuid4().hex}.sst"
                    out = _open_out(path)
                    writer = Writer(out)
                writer.add(key_bytes(d), v.as_buffer().to_pybytes())
        if writer is not None:
            close()
        cols = list(zip(*made)) or [[]] * 7
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["shard", "first_key", "last_key", "path", "docs", "ids", "bytes"])

    return run


MANIFEST = "shard int, first_key long, last_key long, path string, docs long, ids long, bytes long"


def ranges(rows: DataFrame) -> list[int]:
    """Ascending doc_ids at which ranges of about RANGE_BYTES of text begin; none if all fits in one. One number a range reaches the driver."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // RANGE_BYTES)
    if n <= 1:
        return []
    # A document stands once for each unit of its bytes, for the rest by chance, so that quantiles are those of bytes.
    chance = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / (1 << 30)
    times = F.floor(F.octet_length("text") / (RANGE_BYTES * UNIT) + chance).cast("int")
    weighed = rows.select(F.explode(F.array_repeat("doc_id", times)).alias("doc_id"))
    found = weighed.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0]
    return sorted(set(found or []))


def write_tables(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Encode each document and write table files over disjoint, ascending ranges of doc_id; returns the manifest of finished files.

    Ids must be below 65,536; with a larger vocabulary it raises ValueError. An attempt writes files of its own name and only a finished task's files are in the
    manifest, so a lost executor's leavings are never read. Ids pass one shuffle.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    edges = ranges(rows)
    encoded = rows.mapInArrow(_encode(edges, vocabulary, end_id), "shard int, doc_id long, ids binary")
    dealt = encoded.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    return written(dealt.mapInArrow(_write(folder), MANIFEST), "manifest")


def _read_back(it):
    for batch in it:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            rows, at = [], base
            for key, value in open_table(path).scan():
                ids = np.frombuffer(value, "<u2")
                rows.append((key_int(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
                if len(rows) == 8192:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tables(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each entry of the files, start counted over all files in key order.

    The running sum is over the manifest, a row for each file of some 64 to 256 MB.
    """
    before = Window.orderBy("shard", "first_key", "last_key", "path").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    parts = max(1, manifest.count())
    return based.repartition(parts, "path").mapInArrow(_read_back, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, written as table files and read back from them.

    Null text counts as empty and has the end id alone. Rows that repeat a doc_id are entries
    of their own, next to each other; rows without a doc_id have no key and are left out. Very long
    texts are one entry. An empty table has no files and an empty result. Other columns are ignored.
    """
    return read_tables(write_tables(table(spark, sf_dir, "documents"), new_path(spark, "sst")))


ORACLE: dict[str, str] = {}
