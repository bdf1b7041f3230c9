"""Packing of documents into training sequences: first-fit decreasing with a tournament
tree of bin capacities, run independently in randomised groups of documents.

Nulls and edge cases: a null text counts as empty, so its document is the end id alone;
a null doc_id is kept as null; rows that repeat a doc_id
are packed as documents of their own; an empty table gives no pieces; other columns of
the input are ignored. Ties in length go by doc_id, then start, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.tokens import encoder
from quire.llm.workspace import runs, slices

_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, pack_group bigint, ids binary"
PACKED = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class CapacityTree:
    """A tournament over bins: each inner node has the larger free capacity of its two
    children, so the leftmost bin with room is found in one descent."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.free = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, free capacity before) of the leftmost bin with room for ``length``."""
        free, at = self.free, 1
        if free[1] < length:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if free[at] < length:
                at += 1
        before, place = free[at], at - self.leaves
        free[at] = before - length
        while at > 1:
            at //= 2
            most = max(free[2 * at], free[2 * at + 1])
            if free[at] == most:
                break
            free[at] = most
        return place, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; ``lengths`` must not increase. Bins count from 0 without gaps."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    full = int((lengths == capacity).sum())  # these stand first and fill a bin each
    bins[:full] = np.arange(full)
    if full < len(lengths):
        tree = CapacityTree(len(lengths) - full, capacity)
        for i in range(full, len(lengths)):
            place, before = tree.place(int(lengths[i]))
            bins[i], offsets[i] = full + place, capacity - before
    return bins, offsets


def _cut(vocabulary: str, end_id: int, capacity: int, groups: int):
    """Encode documents and cut each into pieces of ``capacity`` ids and a remainder, in neighbouring groups."""

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in slices(batches, 1000):
            flat, offsets = encode(batch.column("text").to_pylist())
            doc_ids, first = batch.column("doc_id").to_pylist(), batch.column("pack_group").to_pylist()
            rows: list[tuple] = []
            for i, (doc, group) in enumerate(zip(doc_ids, first, strict=True)):
                ids = np.append(flat[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                total = len(ids) // 4
                rows += [(doc, s, min(capacity, total - s), total, (group + s // capacity) % groups, ids[4 * s : 4 * (s + capacity)]) for s in range(0, total, capacity)]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "pack_group", "ids"])

    return run


def _pack(capacity: int):
    def run(batches):
        for (group,), table in runs(batches, ["pack_group"]):
            lengths = table.column("length").to_numpy()
            doc = table.column("doc_id").to_numpy(zero_copy_only=False).astype(np.float64)
            exact = np.where(np.isnan(doc), -1, 0)
            order = np.lexsort((table.column("start").to_numpy(), table.column("doc_id").fill_null(0).to_numpy(), exact, -lengths))
            bins, offsets = first_fit_decreasing(lengths[order], capacity)
            table = table.take(pa.array(order))
            out = table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array((int(group) << 32) + bins)).append_column("offset", pa.array(offsets))
            yield from out.select(["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]).to_batches(max_chunksize=2000)

    return run


#: Bytes of text in a group, about: some four million ids at most.
GROUP_BYTES = 1 << 23


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, group_docs: int = 2048, seed: int = 7) -> DataFrame:
    """Pieces of all documents with their sequence and place in it, and their ids as
    little-endian unsigned 32-bit integers.

    A document's group is a seeded hash of its doc_id and text, so groups are random, alike in size
    (at most about ``group_docs`` documents and ``GROUP_BYTES`` of text each) whatever the source, and the same in
    every attempt; the pieces of a long document go to neighbouring groups, so that it swells none.
    Ids cross one shuffle, by group; a task holds one group at a time."""
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, math.ceil(n / group_docs), math.ceil((size or 0) / GROUP_BYTES))
    picked = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups)).alias("pack_group"))
    pieces = picked.mapInArrow(_cut(vocabulary, end_id, capacity, groups), _PIECES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(groups / 8))
    return pieces.repartition(min(tasks, groups), "pack_group").sortWithinPartitions("pack_group").mapInArrow(_pack(capacity), PACKED)
