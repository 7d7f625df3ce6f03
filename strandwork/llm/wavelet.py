"""Token shards as wavelet matrices: one compressed file for each shard, which answers access, count and occurrence queries.

File format (little-endian): the magic ``WVM1``, the header's length (4 bytes), a JSON header, the
documents' ids and lengths (int64 each), the block index, the blocks. Plane by plane from the highest
bit, the bits of the ids in that plane's order are packed eight to a byte, lowest first, and cut into
blocks of 2^16 bits, each compressed by zstd. The index holds for each block the ones before it in its
plane and the end of its bytes. The ids of a plane are dealt stably to the next, zeros before ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

MAGIC, BLOCK_BITS, LEVEL = b"WVM1", 1 << 16, 1
BLOCK = BLOCK_BITS // 8
#: A shard is closed when it has so many ids; the id that ends a document.
SHARD_IDS, END_ID = 1 << 22, 0
MANIFEST = "part int, no int, path string, n_docs long, n_ids long"


def encode(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, null_docs: list[int] = ()) -> bytes:
    """The file of a shard: ``ids`` of its documents in order, ``lengths`` ids for each of ``doc_ids``."""
    n, bits = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    ones_before, ends, blocks, zeros, done = [], [], [], [], 0
    for b in range(bits - 1, -1, -1):
        one = (now & now.dtype.type(1 << b)) != 0
        packed = np.packbits(one, bitorder="little").tobytes()
        per_byte = np.bitwise_count(np.frombuffer(packed.ljust(-(-len(packed) // BLOCK) * BLOCK, b"\0"), np.uint8))
        counts = per_byte.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        ones_before.append(np.cumsum(counts) - counts)
        zeros.append(n - int(counts.sum()))
        for at in range(0, len(packed), BLOCK):
            blocks.append(squeeze(packed[at : at + BLOCK]))
            done += len(blocks[-1])
            ends.append(done)
        now = np.concatenate([now[np.flatnonzero(~one)], now[np.flatnonzero(one)]])
    header = json.dumps({"n": n, "bits": bits, "docs": len(doc_ids), "zeros": zeros, "null_docs": list(null_docs)}).encode()
    index = [np.concatenate(ones_before) if n else np.zeros(0), np.array(ends)]
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *(np.asarray(x).astype("<i8").tobytes() for x in (doc_ids, lengths, *index)), *blocks])


class Shard:
    """A shard's file, opened; blocks are decompressed as they are asked for."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(data[4:8], "little")
        head = json.loads(data[8 : 8 + size])
        self.n, self.bits, self.zeros, self.data = head["n"], head["bits"], head["zeros"], data
        self.per_plane = -(-self.n // BLOCK_BITS)
        at = 8 + size
        out = []
        for count in (head["docs"], head["docs"], *[self.bits * self.per_plane] * 2):
            out.append(np.frombuffer(data, "<i8", count, at))
            at += 8 * count
        self.doc_ids, self.lengths, self.before, self.ends = out
        self.null_docs, self.base = head["null_docs"], at
        self.block = lru_cache(64)(self._block)

    def _block(self, k: int) -> np.ndarray:
        begin = int(self.ends[k - 1]) if k else 0
        packed = zstandard.ZstdDecompressor().decompress(self.data[self.base + begin : self.base + int(self.ends[k])])
        return np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")

    def ones(self, plane: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        k = plane * self.per_plane + i // BLOCK_BITS
        return int(self.before[k]) + int(self.block(k)[: i % BLOCK_BITS].sum())

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        found = 0
        for plane in range(self.bits):
            bit = int(self.block(plane * self.per_plane + i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self.ones(plane, i)
            found = found << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return found

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for plane in range(self.bits):
            a, b = self.ones(plane, begin), self.ones(plane, end)
            begin, end = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.bits - 1 - plane) & 1 else (begin - a, end - b)
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often ``token`` stands in places ``begin`` to ``end``."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, begin, self.n if end is None else end)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of ``token``; -1 if there are fewer."""
        if token >> self.bits:
            return -1
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for plane in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - plane) & 1
            i = self._select(plane, one, i - self.zeros[plane] if one else i)
        return i

    def _select(self, plane: int, one: int, k: int) -> int:
        first = plane * self.per_plane
        before = self.before[first : first + self.per_plane]
        before = before if one else np.arange(self.per_plane) * BLOCK_BITS - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = self.block(first + block)[: self.n - block * BLOCK_BITS]
        return block * BLOCK_BITS + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def ids(self) -> np.ndarray:
        """All ids: each plane deals its bits back to the order above it."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for plane in range(self.bits - 1, -1, -1):
            k = plane * self.per_plane
            one = np.concatenate([self._block(k + j) for j in range(self.per_plane)] or [np.zeros(0, np.uint8)])[: self.n].astype(bool)
            up = np.empty(self.n, kind)
            up[~one] = now[: self.zeros[plane]]
            up[one] = now[self.zeros[plane] :] | kind(1 << (self.bits - 1 - plane))
            now = up
        return now


def write(docs: DataFrame, folder: str, path: str | None = None, shard_ids: int = SHARD_IDS, end: int = END_ID, added: bool = False) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order as shard files; returns the manifest (part, no, path, n_docs, n_ids).

    Documents are dealt by ranges of doc_id and sorted, each range streams into its own files, and a
    file is renamed into place when whole, so a task that runs again overwrites its own files with
    the same bytes. ``added``: added tokens in a text get their own ids. A null text is empty; null ids come first; rows that repeat a doc_id stay, by text.
    """
    path = path or common.tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, n = TaskContext.get().partitionId(), 0, [], 0
        store, root = fs.FileSystem.from_uri(folder)

        def close() -> pa.RecordBatch:
            doc = np.concatenate([np.array([x or 0 for x in h[0]], np.int64) for h in held])
            data = encode(np.concatenate([h[1] for h in held]), doc, np.concatenate([h[2] for h in held]), [i for i, x in enumerate(x for h in held for x in h[0]) if x is None])
            name = f"{root}/{part:06d}-{no:06d}.wvm"
            with store.open_output_stream(draft := f"{name}.{uuid.uuid4().hex}") as f:
                f.write(data)
            store.move(draft, name)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "no": pa.array([no], pa.int32()), "path": [name], "n_docs": pa.array([len(doc)], pa.int64()), "n_ids": pa.array([n], pa.int64())})

        for batch in batches:
            for piece in common.slices(batch, "text"):
                if not piece.num_rows:
                    continue
                ids, starts = bpe.encoder(path, added).encode([x or "" for x in piece.column("text").to_pylist()], end)
                held.append((piece.column("doc_id").to_pylist(), ids, np.diff(starts)))
                n += len(ids)
                if n >= shard_ids:
                    yield close()
                    no, held, n = no + 1, [], 0
        if held:
            yield close()

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text"))
    return common.checkpointed(rows.sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST))


def read(manifest: DataFrame, folder: str, most_ids: int = 1 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit), read from the files."""
    spark = manifest.sparkSession
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("no")) - F.col("n_ids")
    shards = manifest.join(before, "part").select("path", (F.col("before") + inside).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    shard = Shard(f.read())
                ids, ends, null = shard.ids().astype("<u4"), np.cumsum(shard.lengths), np.zeros(len(shard.doc_ids), bool)
                null[shard.null_docs] = True
                first = 0
                while first < len(ends):
                    origin = int(ends[first] - shard.lengths[first])
                    last = max(first + 1, int(np.searchsorted(ends, origin + most_ids, "right")))
                    begins = np.append(ends[first:last] - shard.lengths[first:last], ends[last - 1])
                    data = pa.BinaryArray.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(((begins - origin) * 4).astype(np.int32)), pa.py_buffer(ids[origin : begins[-1]].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[first:last], mask=null[first:last]), pa.array(start + begins[:-1]), pa.array(shard.lengths[first:last]), data], names=["doc_id", "start", "n_tokens", "ids"])
                    first = last

    return shards.repartition(common.shuffle_partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, **options: object) -> DataFrame:
    """The contract's columns, from files written to a new folder in the shared one."""
    folder = f"{common.shared_dir(docs.sparkSession).rstrip('/')}/wavelet-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read(write(docs, folder, **options), folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
