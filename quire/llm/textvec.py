"""Vectorised text kernels: words, shingles and lines of a batch of documents.

A batch of texts becomes one byte buffer; words are the maximal runs of bytes
other than space and 0x09-0x0D, which is exactly the rule
``[^\\x20\\x09-\\x0D]+`` because UTF-8 keeps those bytes for those characters.
A word's hash is a polynomial over its bytes modulo 2**64, taken from one
running sum over the buffer, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that one kernel call holds at once; longer batches are cut between documents.
BLOCK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES)
        base, inverse = _ODD, pow(_ODD, -1, 1 << 64)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[0]


def running_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = _power_table(len(data) + 1)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a block of documents: byte spans, hashes and the document of each."""

    data: np.ndarray  # uint8 buffer, documents joined by a newline
    doc_start: np.ndarray  # int64, byte where each document starts
    start: np.ndarray  # int64, byte where each word starts
    end: np.ndarray  # int64, byte after each word
    hash: np.ndarray  # uint64
    first: np.ndarray  # int64, n_docs + 1: words of document d are first[d]:first[d+1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES):
    """(first index, encoded texts) of runs of documents of about ``limit`` bytes."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield at, held


def words(encoded: list[bytes], lower: bool) -> Words:
    raw = b"\n".join(encoded) + b"\n"
    data = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    sizes = np.fromiter((len(b) + 1 for b in encoded), dtype=np.int64, count=len(encoded))
    doc_start = np.zeros(len(encoded) + 1, dtype=np.int64)
    np.cumsum(sizes, out=doc_start[1:])
    gap = _SEPARATOR[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]  # the buffer ends with a newline
    h = running_hash(data, start, end)
    return Words(data, doc_start, start, end, h, np.searchsorted(start, doc_start))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbouring words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : k + n] * np.uint64((2 * k + 1) * _ODD & _MASK))
    return out


def shingle_sets(texts: list[str | None], width: int):
    """For each text in order: the sorted distinct hashes of its ``width``-word
    shingles; the whole sequence as one shingle if it has fewer words; empty
    without words. A-Z count as lower case."""
    for _, encoded in blocks(texts):
        w = words(encoded, lower=True)
        whole = windows(w.hash, width)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            n = b - a
            if n >= width:
                yield np.unique(whole[a : b - width + 1])
            elif n:
                yield mix(windows(w.hash[a:b], int(n)) + np.uint64(n))
            else:
                yield np.zeros(0, dtype=np.uint64)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a digest of a sorted hash set."""
    d = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def word_counts(texts: list[str | None]) -> np.ndarray:
    out = [words(encoded, lower=False).counts for _, encoded in blocks(texts)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
