"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are reduced to lower-case letters with single spaces between words. Each run of 1, 2 or
3 characters falls into one of 2**16 hash buckets of its order. Bucket counts for each language
are summed over the training rows, and the smoothed log-probability matrix, languages x
(3 * 2**16) of 4 bytes, is broadcast; a batch is scored in numpy with one gather for each language
and order and running sums cut at the documents' ends. Very long texts are scored in pieces that
overlap, so that memory stays bounded. The language is that of the largest posterior; the score is its posterior
after the log-posteriors of texts of over ``SCORED_GRAMS`` n-grams are scaled down to so many.

The model is fitted on at most about ``train_rows`` labelled rows (all of them below that),
picked by a hash of doc_id; every document is scored whole.

Nulls and edge cases: a text that is null or has no letter gets ``und`` with score 0, as does
every text if there is no labelled row to learn from; rows with a null lang or doc_id are not learnt from;
ties go to the language first by code point; an empty table gives an empty result; other
columns are ignored, or passed through by ``keep_known``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.workspace import slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: The score takes the mean evidence of a text's n-grams this many times at most, so that scores don't all end at 1.
SCORED_GRAMS = 60
#: Texts whose characters are held as arrays at once.
SLICE = 250
SLICE_TEXT = 1 << 21
#: Characters of a longer text that are held as arrays at once.
LONG = 1 << 20
_STEP = np.uint32(0x9E3779B1)
_fold: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """For each code point: its lower case if a letter, else a space; 0 stays 0."""
    if not _fold:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x323B0):  # there are no letters above
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low[0]) if low[0].isalpha() else c
        table[0] = 0
        _fold.append(table)
    return _fold[0]


@dataclass
class Grams:
    """Characters of a batch and the span of each document in them."""

    chars: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray

    def buckets(self, order: int) -> np.ndarray:
        """The bucket of the n-gram that starts at each character."""
        c = self.chars
        n = len(c) - order + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        h = np.full(n, order, dtype=np.uint32)
        for k in range(order):
            h = (h ^ c[k : k + n]) * _STEP
            h ^= h >> np.uint32(15)
        return (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def grams(texts: list[str | None]) -> Grams:
    """Folded characters, a zero before each document."""
    raw = np.frombuffer("\0".join(["", *[(t or "").replace("\0", " ") for t in texts]]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _folding()[raw]
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | ((c[:-1] != 32) & (c[:-1] != 0))
    c = c[keep]
    start = np.flatnonzero(c == 0) + 1
    end = np.append(start[1:] - 1, len(c))
    is_letter = np.concatenate(([0], np.cumsum((c != 32) & (c != 0))))
    return Grams(c, start, end, is_letter[end] - is_letter[start])


def _text_batches(batches):
    for batch in slices(batches, SLICE, SLICE_TEXT):
        texts = batch.column("text").to_pylist()
        yield batch, grams([t if t and len(t) <= LONG else None for t in texts]), {i: t for i, t in enumerate(texts) if t and len(t) > LONG}


def long_grams(text: str):
    """(order's place, buckets, letters) of a text piece by piece: all its n-grams, each once."""
    tail = np.zeros(0, dtype=np.uint32)  # the folded signs before a piece that n-grams reach back to
    for at in range(0, len(text), LONG):
        c = _folding()[np.frombuffer(text[at : at + LONG].replace("\0", " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        before = np.concatenate((tail[-1:] if len(tail) else np.full(1, 32, dtype=np.uint32), c[:-1]))
        c = c[(c != 32) | (before != 32)]
        for k, order in enumerate(ORDERS):
            joined = np.concatenate((tail[len(tail) - min(len(tail), order - 1) :], c))
            yield k, Grams(joined, None, None, None).buckets(order), int((c != 32).sum()) if k == 0 else 0
        tail = np.concatenate((tail, c))[-(max(ORDERS) - 1) :]


def _count(langs: list[str]):
    """(language, bucket, count) of a partition's labelled rows."""
    place = {x: i for i, x in enumerate(langs)}

    def run(batches):
        total = np.zeros((len(langs), len(ORDERS), BUCKETS), dtype=np.int64)
        for batch, g, long in _text_batches(batches):
            of = np.array([place[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for k, order in enumerate(ORDERS):
                b = g.buckets(order)
                edge = np.zeros(len(g.chars) + 1, dtype=np.int64)
                last = np.maximum(g.end - order + 1, g.start)
                np.add.at(edge, g.start, of + 1)
                np.add.at(edge, last, -(of + 1))
                lang = np.cumsum(edge)[: len(b)] - 1
                ok = lang >= 0
                total[:, k] += np.bincount(lang[ok] * BUCKETS + b[ok], minlength=len(langs) * BUCKETS).reshape(len(langs), BUCKETS)
            for i, text in long.items():
                for k, b, _ in long_grams(text):
                    total[of[i], k] += np.bincount(b, minlength=BUCKETS)
        lang, order, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang_at": pa.array(lang), "bucket": pa.array(order * BUCKETS + bucket), "n": pa.array(total[lang, order, bucket])})

    return run


@dataclass
class LanguageModel:
    langs: list[str]
    prior: np.ndarray  # log share of each language
    logp: np.ndarray  # float32, languages x orders x buckets

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        g = grams([t if t and len(t) <= LONG else None for t in texts])
        n_docs = len(texts)
        if not self.langs:
            return [UNKNOWN] * n_docs, np.zeros(n_docs)
        total = np.zeros((len(self.langs), n_docs))
        number = np.zeros(n_docs)
        for k, order in enumerate(ORDERS):
            b = g.buckets(order)
            last = np.minimum(np.maximum(g.end - order + 1, g.start), len(b))
            first = np.minimum(g.start, last)
            number += last - first
            for i in range(len(self.langs)):
                run = np.concatenate(([0.0], np.cumsum(self.logp[i, k][b], dtype=np.float64)))
                total[i] += run[last] - run[first]
        for d, text in enumerate(texts):
            if text and len(text) > LONG:
                for k, b, letters in long_grams(text):
                    g.letters[d] += letters
                    number[d] += len(b)
                    total[:, d] += self.logp[:, k][:, b].sum(axis=1, dtype=np.float64)
        z = self.prior[:, None] + total
        best = z.argmax(axis=0)
        p = np.exp((z - z.max(axis=0)) * np.minimum(1.0, SCORED_GRAMS / np.maximum(number, 1)))
        p /= p.sum(axis=0)
        some = g.letters > 0
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, p[best, np.arange(n_docs)], 0.0)


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, train_rows: int = 20_000, seed: int = 11, smoothing: float = 0.5) -> LanguageModel:
    """Fit on labelled rows outside the held-out fold. What reaches the driver is bounded by
    languages x buckets."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    shares = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, rows = sorted(shares), sum(shares.values())
    if not langs:
        return LanguageModel([], np.zeros(0), np.zeros((0, len(ORDERS), BUCKETS), dtype=np.float32))
    if rows > train_rows:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(train_rows / rows * (1 << 30)))
    counted = labelled.mapInArrow(_count(langs), "lang_at bigint, bucket bigint, n bigint").groupBy("lang_at", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), len(ORDERS) * BUCKETS))
    counts[counted.column("lang_at").to_numpy(), counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    counts = counts.reshape(len(langs), len(ORDERS), BUCKETS) + smoothing
    logp = np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)
    return LanguageModel(langs, np.log(np.array([shares[x] for x in langs]) / rows), logp)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, SLICE, SLICE_TEXT):
            langs, scores = spread.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least_score``, all columns as they are."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, SLICE, SLICE_TEXT):
            langs, scores = spread.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in zip(langs, scores.tolist(), strict=True)]))

    return docs.mapInArrow(run, docs.schema)
