"""Token-id files with bit-plane shuffling.

A shard holds fixed-size blocks of ids. Each block's unsigned 32-bit ids are transposed
into 32 bit planes or 4 byte planes, each plane is compressed with zstandard on its own
(an all-zero plane takes no bytes), and the chunk index at the end of the file has the
place of every block and the length of every plane, then doc_id and id count of each
document. Shards follow one another in ascending doc_id order.

    "QPLANES1" | planes of block 0 | planes of block 1 | ... | index | index length | "QPLANES1"

Nulls and edge cases: a null text counts as empty, so its document is the end id alone; a
null doc_id sorts first and is read back as null; rows that repeat a doc_id are kept, in
order of their text; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.tokens import encoder
from quire.llm.workspace import fresh_dir, publish, slices

MAGIC = b"QPLANES1"
BLOCK = 1 << 16


def split_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first."""
    as_bytes = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range(4)]
    out = []
    for k in range(32):
        plane = (as_bytes[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1)
        out.append(np.packbits(plane, bitorder="little").tobytes())
    return out


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its 4 byte planes or 32 bit planes."""
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    out = np.zeros((n, 4), dtype=np.uint8)
    for k, p in enumerate(planes):
        out[:, k // 8] |= np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") << np.uint8(k % 8)
    return out.reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard to a stream, a block at a time."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False, level: int = 3):
        self.out, self.block, self.bits = out, block, bits
        self.squeeze = zstandard.ZstdCompressor(level=level).compress
        self.held: list[np.ndarray] = []
        self.n_held = self.at = self.total = 0
        self.index: list[tuple] = []
        self.docs: list[tuple[int | None, int]] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for s in range(0, whole, self.block):
                self._flush(flat[s : s + self.block])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _flush(self, ids: np.ndarray) -> None:
        start, sizes = self.at, []
        for plane in split_planes(ids, self.bits):
            data = self.squeeze(plane) if plane.count(0) != len(plane) else b""
            self._write(data)
            sizes.append(len(data))
        self.index.append((start, len(ids), sizes))

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        planes = 32 if self.bits else 4
        head = struct.pack("<IIQQ", self.block, planes, len(self.index), len(self.docs))
        chunks = b"".join(struct.pack(f"<QI{planes}I", a, n, *sizes) for a, n, sizes in self.index)
        ids = np.array([d or 0 for d, _ in self.docs], dtype="<i8").tobytes()
        nulls = np.array([d is None for d, _ in self.docs], dtype=np.uint8).tobytes()
        counts = np.array([n for _, n in self.docs], dtype="<i8").tobytes()
        packed = self.squeeze(head + chunks + ids + nulls + counts)
        self._write(packed + struct.pack("<Q", len(packed)) + MAGIC)


class ShardReader:
    """Reads a shard by its chunk index; ``source`` can seek."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not an id shard")
        (length,) = struct.unpack("<Q", tail[:8])
        source.seek(size - 16 - length)
        index = zstandard.ZstdDecompressor().decompress(source.read(length))
        self.block, self.planes, n_blocks, n_docs = struct.unpack_from("<IIQQ", index)
        at, one = 24, struct.calcsize(f"<QI{self.planes}I")
        self.blocks = [struct.unpack_from(f"<QI{self.planes}I", index, at + one * k) for k in range(n_blocks)]
        at += one * n_blocks
        ids = np.frombuffer(index, "<i8", n_docs, at)
        nulls = np.frombuffer(index, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
        self.counts = np.frombuffer(index, "<i8", n_docs, at + 9 * n_docs)

    def read_block(self, k: int) -> np.ndarray:
        start, n, *sizes = self.blocks[k]
        self.source.seek(start)
        data, at, out = self.source.read(sum(sizes)), 0, []
        plane_bytes = n if self.planes == 4 else (n + 7) // 8
        grow = zstandard.ZstdDecompressor().decompress
        for size in sizes:
            out.append(grow(data[at : at + size], max_output_size=plane_bytes) if size else bytes(plane_bytes))
            at += size
        return join_planes(out, n)

    def documents(self):
        """(doc_id, ids) of each document in order, with one block in memory besides it."""
        held, k = np.zeros(0, dtype=np.uint32), 0
        for doc, n in zip(self.doc_ids, self.counts.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.read_block(k))
                have += len(parts[-1])
                k += 1
            flat = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield doc, flat[:n]
            held = flat[n:]


def _shard_name(k: int) -> str:
    return f"shard-{k:06d}.qpl"


def _write_shard(folder: str, vocabulary: str, end_id: int, bits: bool):
    def run(batches):
        encode = encoder(vocabulary).encode
        shard = TaskContext.get().partitionId()
        system, path = fs.FileSystem.from_uri(folder)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        done = {}

        def write(out):
            writer = ShardWriter(out, bits=bits)
            end = np.array([end_id], dtype=np.uint32)
            for source in ([first], batches):
                for batch in slices(source, 1000):
                    flat, at = encode(batch.column("text").to_pylist())
                    for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                        writer.add(doc, np.concatenate([flat[at[i] : at[i + 1]], end]))
            writer.close()
            done.update(n_docs=len(writer.docs), n_ids=writer.total, n_bytes=writer.at)

        publish(system, f"{path}/{_shard_name(shard)}", write)
        yield pa.RecordBatch.from_pydict({"shard": [shard], **{k: [v] for k, v in done.items()}})

    return run


#: Bytes of text in a shard, about, whatever the number of shuffle partitions.
SHARD_BYTES = 1 << 28


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, bits: bool = False) -> list[dict]:
    """Encode whole texts and write them to shards under ``folder``, in ascending doc_id
    order over the shards by name. Returns the manifest: one row for each shard.

    Texts cross one range shuffle; a task encodes and writes its range block by block, and
    its file appears under its name only when complete."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = docs.select("doc_id", "text").repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_write_shard(folder, vocabulary, end_id, bits), "shard bigint, n_docs bigint, n_ids bigint, n_bytes bigint").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["shard"])


def read_ids(spark, folder: str, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """Each document of the shards: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, if asked, its ids as bytes."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = [m["shard"] for m in manifest]
    starts = np.cumsum([0] + [m["n_ids"] for m in manifest[:-1]]).tolist()

    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                with system.open_input_file(f"{path}/{_shard_name(shards[k])}") as source:
                    at, rows = starts[k], []
                    for doc, ids in ShardReader(source).documents():
                        data = ids.astype("<u4").tobytes()
                        rows.append((doc, at, len(ids), zlib.crc32(data), data)[: 4 + with_ids])
                        at += len(ids)
                        if len(rows) >= 2000:
                            yield _batch(rows, with_ids)
                            rows = []
                    if rows:
                        yield _batch(rows, with_ids)

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(run, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def encode_to_files(docs: DataFrame, vocabulary: str, end_id: int = 2, bits: bool = False) -> tuple[str, list[dict]]:
    """Write the documents' ids to a new folder of the shared file system."""
    folder = fresh_dir(docs.sparkSession, "ids")
    return folder, write_ids(docs, folder, vocabulary, end_id, bits)
