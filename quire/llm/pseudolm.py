"""Document scores by masked pseudo-likelihood.

A small bidirectional window network in numpy predicts every token of a document from the two
tokens on each side; the sum of the conditional log-probabilities scores the document.

Tokens are words: the 512 most frequent of the corpus have a class of their own, any other falls by hash into
one of 512 classes. A class is a pair of two digits to base 32, predicted one after the other, so
a token costs two softmaxes of 32. A word of a shared class costs log P(word | class) besides: with counts of
the whole corpus, (count of word + 1) / (count of class + its distinct words + 1), where an unseen word has
count 0. All words' counts are a table in the shared folder; they and the distinct words of each document meet
in parts by the word's hash, many to a row. Training is data parallel over
all documents: in each of ``ROUNDS`` rounds every partition starts from the same weights, takes
gradient steps on one position in ``ROUNDS`` of all its documents, and the weights are averaged by token numbers;
no position is in two rounds and every position is in one.

Nulls and edge cases: a null or wordless text has 0 tokens, score 0 and a null mean; a null doc_id is
kept as null; repeated rows score alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.llm.textvec import blocks, mix, words
from quire.llm.workspace import dealt, planes, runs, slices, stored, unplanes

OWN, DIGITS = 512, 32
CLASSES = DIGITS * DIGITS
NONE = CLASSES  # stands beyond either end of a document
WIDTH, HIDDEN = 12, 32
REACH = (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 2, 2048, 0.08
#: Sums of weights and logarithms count in units of 1 / UNIT, so that their order does not matter.
UNIT = 1 << 26
#: Logits within this have exponentials and sums of them that a float32 holds.
SAFE = 80
#: Bits of a hash by which a word finds its place in the vocabulary.
SLOT_BITS = 16
#: Parts of the words for each task that they are dealt to, and words of documents that are dealt at once.
PARTS, DEALT = 4, 1 << 20
SHAPES = {"embed": (CLASSES + 1, WIDTH), "w": (len(REACH) * WIDTH, HIDDEN), "b": (HIDDEN,), "high": (HIDDEN, DIGITS), "high_b": (DIGITS,), "given": (DIGITS, HIDDEN), "low": (HIDDEN, DIGITS), "low_b": (DIGITS,)}


def initial(seed: int = 17) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {k: rng.standard_normal(s).astype(np.float32) * np.float32(0.3 / np.sqrt(s[0]) if len(s) > 1 and k != "embed" else 0.1) for k, s in SHAPES.items()}
    for k in ("b", "high_b", "low_b"):
        out[k][:] = 0
    return out


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in SHAPES])


def unflatten(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _summed(row: np.ndarray, values: np.ndarray, like: np.ndarray) -> np.ndarray:
    """An array like ``like``: the sum of the values of each row."""
    if len(like) <= DIGITS:
        hot = np.zeros((len(row), len(like)), dtype=values.dtype)
        hot[np.arange(len(row)), row] = 1
        return hot.T @ values
    return np.stack([np.bincount(row, weights=v, minlength=len(like)) for v in values.T], axis=1).astype(like.dtype)


def _laid(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes with a gap of none around each document, place of each there); ``doc`` ascends."""
    gap = max(REACH)
    place = np.arange(len(ids)) + gap * (doc + 1)
    laid = np.full(place[-1] + gap + 1 if len(ids) else 0, NONE, dtype=np.int64)
    laid[place] = ids
    return laid, place


def _around(laid: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Classes around each place; beyond its document there is none."""
    return laid.take(place[:, None] + np.array(REACH))


def _hidden(p: dict, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = p["embed"].take(context, axis=0).reshape(len(context), -1)
    h = e @ p["w"]
    h += p["b"]
    return e, np.tanh(h, out=h)


def _exp(z: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logits, less their row's greatest where some are large; their exponentials), the first in the place of ``z``."""
    z += bias
    if max(z.max(), -z.min()) > SAFE:
        z -= z.max(axis=1, keepdims=True)
    return z, np.exp(z)


def _total(up: np.ndarray) -> np.ndarray:
    """The sum of each row, which the matrix product takes faster than a sum along short rows."""
    return up @ np.ones(up.shape[1], dtype=up.dtype)


def log_probability(p: dict, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    out = np.empty(len(target))
    for s in range(0, len(target), BATCH):  # what one step holds stays in the cache
        part = target[s : s + BATCH]
        _, h = _hidden(p, context[s : s + BATCH])
        hi, rows = part // DIGITS, np.arange(len(part))
        z, up = _exp(h @ p["high"], p["high_b"])
        out[s : s + BATCH] = z[rows, hi] - np.log(_total(up))
        h += p["given"][hi]
        z, up = _exp(h @ p["low"], p["low_b"])
        out[s : s + BATCH] += z[rows, part % DIGITS] - np.log(_total(up))
    return out


class Trainer:
    """Adagrad on mini-batches."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.copy() for k, v in p.items()}
        self.seen = {k: np.full(v.shape, 1e-2, dtype=np.float32) for k, v in p.items()}

    def gradients(self, context: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability."""
        p, rows = self.p, np.arange(len(target))
        e, h = _hidden(p, context)
        hi = target // DIGITS
        h2 = h + p["given"][hi]
        wrong = []
        for z, bias, digit in ((h @ p["high"], p["high_b"], hi), (h2 @ p["low"], p["low_b"], target % DIGITS)):
            _, up = _exp(z, bias)
            up *= (1 / (len(target) * _total(up)))[:, None]
            up[rows, digit] -= up.dtype.type(1 / len(target))
            wrong.append(up)
        dz1, dz2 = wrong
        dh2 = dz2 @ p["low"].T
        da = dz1 @ p["high"].T
        da += dh2
        out = {"high": h.T @ dz1, "high_b": dz1.sum(axis=0), "given": _summed(hi, dh2, p["given"]), "low": h2.T @ dz2, "low_b": dz2.sum(axis=0)}
        h *= h
        da *= np.subtract(1, h, out=h)
        out["embed"] = _summed(context.reshape(-1), (da @ p["w"].T).reshape(-1, WIDTH), p["embed"])
        return out | {"w": e.T @ da, "b": da.sum(axis=0)}

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        for k, g in self.gradients(context, target).items():
            self.seen[k] += g * g
            self.p[k] -= np.float32(RATE) * g / np.sqrt(self.seen[k])


def classes_of(hashes: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The class of each word; ``vocabulary`` is sorted and ``rank`` has each entry's class."""
    out = (OWN + mix(hashes) % np.uint64(CLASSES - OWN)).astype(np.int64)
    if len(vocabulary):
        last = np.uint64((1 << SLOT_BITS) - 1)
        slots, first = np.unique(vocabulary & last, return_index=True)
        entry = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        entry[slots] = first
        at = entry.take((hashes & last).view(np.int64))
        hit = np.flatnonzero(vocabulary.take(at) == hashes)
        out[hit] = rank[at[hit]]
        for k in np.setdiff1d(np.arange(len(vocabulary)), first):  # the few whose slot another has
            out[hashes == vocabulary[k]] = rank[k]
    return out


def _counts(batches):
    for batch in slices(batches, 2000):
        got = [words(encoded, lower=True).hash for _, encoded in blocks(batch.column("text").to_pylist())]
        value, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"word": pa.array(value.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def _parameters(start: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray, turn: int):
    """(slot, value in units of 1 / UNIT, weight) of a partition's trained parameters."""

    def run(batches):
        trainer, tokens = Trainer(unflatten(start)), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, 2000):
            for _, encoded in blocks(batch.column("text").to_pylist()):
                w = words(encoded, lower=True)
                ids = classes_of(w.hash, vocabulary, rank)
                doc = np.repeat(np.arange(len(encoded)), w.counts)
                within = np.arange(len(ids)) - w.first[:-1][doc]
                at = np.flatnonzero((within + w.counts[doc]) % ROUNDS == turn)
                if len(at):
                    at = at[np.argsort(mix(at.astype(np.uint64)))]
                    laid, place = _laid(ids, doc)
                    held.append((_around(laid, place[at]), ids[at]))
                    tokens += len(at)
                while sum(len(t) for _, t in held) >= BATCH:
                    context, target = (np.concatenate(c) for c in zip(*held, strict=True))
                    whole = len(target) // BATCH * BATCH
                    for s in range(0, whole, BATCH):
                        trainer.step(context[s : s + BATCH], target[s : s + BATCH])
                    held = [(context[whole:], target[whole:])]
        if tokens:
            if held and len(held[0][1]):
                context, target = (np.concatenate(c) for c in zip(*held, strict=True))
                trainer.step(context, target)
            v = np.rint(flatten(trainer.p).astype(np.float64) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(len(v))), "value": pa.array(v), "weight": pa.array(np.full(len(v), tokens))})

    return run


def _class_sizes(vocabulary: np.ndarray, rank: np.ndarray):
    """(class, n) of a batch of word counts: occurrences and distinct words of each shared class."""

    def run(batches):
        for batch in batches:
            ids = classes_of(batch.column("word").to_numpy().view(np.uint64), vocabulary, rank)
            n = np.bincount(ids, weights=batch.column("n").to_numpy() + 1, minlength=CLASSES).astype(np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"class": pa.array(at), "n": pa.array(n[at])})

    return run


Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, DataFrame]


def train(docs: DataFrame) -> Model:
    """(parameters, vocabulary, classes, class sizes, word counts). The driver gets 512 words, the classes'
    sizes and the model's weights; the counts of all words stay a table."""
    texts = docs.select("text").where("text is not null")
    counts = stored(texts.mapInArrow(_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(OWN).collect()
    vocabulary = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, rank = vocabulary[order], order.astype(np.int64)
    sizes = np.ones(CLASSES)  # one for the words never seen
    for r in counts.mapInArrow(_class_sizes(vocabulary, rank), "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect():
        sizes[r["class"]] += r["n"]
    now = flatten(initial())
    for turn in range(ROUNDS):
        got = texts.mapInArrow(_parameters(now, vocabulary, rank, turn), "slot bigint, value bigint, weight bigint")
        whole = F.sum(F.col("value").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)"))  # exact in any order
        got = got.groupBy("slot").agg((whole.cast("double") / F.sum("weight")).alias("v")).toArrow()
        if got.num_rows:
            now = now.copy()
            now[got.column("slot").to_numpy()] = got.column("v").to_numpy() / UNIT
    return now, vocabulary, rank, sizes, counts


def _distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one, number) of each distinct word of each document."""
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (hashes[order[1:]] != hashes[order[:-1]])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


_MEETING = {"part": pa.int64(), "number": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "own": pa.float64(), "numbers": pa.binary(), "words": pa.binary(), "times": pa.binary()}
_MEETING_DDL = "part bigint, number bigint, doc_id bigint, n_tokens bigint, own double, numbers binary, words binary, times binary"


def _rows(**columns) -> pa.RecordBatch:
    """Rows of ``_MEETING``, null in the columns that are not given."""
    n = len(columns["part"])
    given = {k: c if isinstance(c, pa.Array) else pa.array(c, _MEETING[k]) for k, c in columns.items()}
    return pa.RecordBatch.from_pydict({k: given.get(k, pa.nulls(n, kind)) for k, kind in _MEETING.items()})


def _by_part(part: np.ndarray, times: np.ndarray, word: np.ndarray | None = None, number: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each part of what is given: words, numbers of documents as differences, and a number for each."""
    order, starts, ends = dealt(part.astype(np.min_scalar_type(int(part.max()))))

    def cut(x: np.ndarray, to) -> list[bytes]:
        x = x[order]
        return [to(x[i:j]) for i, j in zip(starts, ends, strict=True)]

    columns = {} if word is None else {"words": cut(word, np.ndarray.tobytes)}
    if number is not None:
        columns["numbers"] = cut(number, lambda x: planes(np.diff(x, prepend=0)))
    return _rows(part=part[order][starts].astype(np.int64), times=cut(times, planes), **columns)


def _words_by_part(parts: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    word, times, *number = (np.concatenate(x) for x in zip(*held, strict=True))
    return _by_part(word % np.uint64(parts), times, word, *number)


def _pack_counts(parts: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("word").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
            size += batch.num_rows
            if size >= DEALT:
                yield _words_by_part(parts, held)
                held, size = [], 0
        if size:
            yield _words_by_part(parts, held)

    return run


def _sums(parts: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The sum of each number's values, by parts of the numbers."""
    number, inside = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(number, kind="stable")
    number, inside = number[order], inside[order]
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    return _by_part(mix(number[first]) % np.uint64(parts), np.add.reduceat(inside, first), number=number[first])


def _meet(parts: int):
    """Documents' own rows as they are; and sums of the logarithms of their words' counts plus one, in units of 1 / UNIT."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, table in runs(batches, ["part"]):
            packed = pc.is_valid(table.column("words"))
            yield from table.filter(pc.invert(packed)).to_batches()
            rows = [[r[k] for k in ("numbers", "words", "times")] for r in table.filter(packed).select(["numbers", "words", "times"]).to_pylist()]
            known = [(np.frombuffer(w, dtype=np.uint64), unplanes(n)) for number, w, n in rows if number is None]
            known.append((np.full(1, -1).view(np.uint64), np.zeros(1, dtype=np.int64)))  # no word found lies behind the last
            word, n = (np.concatenate(x) for x in zip(*known, strict=True))
            order = np.argsort(word, kind="stable")
            word, logs = word[order], np.log(n[order] + 1.0)
            for number, asked, times in rows:
                if number is not None:
                    asked = np.frombuffer(asked, dtype=np.uint64)
                    at = np.searchsorted(word, asked)
                    each = np.where(word[at] == asked, logs[at], 0.0)
                    held.append((np.cumsum(unplanes(number)), np.rint(unplanes(times) * each * UNIT).astype(np.int64)))
                    size += len(asked)
                    if size >= DEALT:
                        yield _sums(parts, held)
                        held, size = [], 0
        if size:
            yield _sums(parts, held)

    return run


def _scores(batches):
    """Each document's own part and the sums of its words."""
    for _, table in runs(batches, ["part"]):
        packed = pc.is_valid(table.column("numbers"))
        docs = table.filter(pc.invert(packed)).sort_by("number")
        number, inside = docs.column("number").to_numpy(), np.zeros(docs.num_rows, dtype=np.int64)
        for row in table.filter(packed).select(["numbers", "times"]).to_pylist():
            inside[np.searchsorted(number, np.cumsum(unplanes(row["numbers"])))] += unplanes(row["times"])  # a row's numbers differ
        score = docs.column("own").to_numpy() + inside / float(UNIT)
        yield from docs.select(["doc_id", "n_tokens"]).append_column("score", pa.array(score)).to_batches()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, score, mean_score) of each document; score is its pseudo-log-likelihood."""
    *fixed, counts = model
    spread = docs.sparkSession.sparkContext.broadcast(tuple(fixed))  # the model's fixed size
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS * tasks

    def run(batches):
        """A row of each document with its score but for its words' counts, and rows of many distinct words in shared
        classes with the numbers of their documents."""
        flat, vocabulary, rank, sizes = spread.value
        p, log_sizes = unflatten(flat), np.log(sizes)
        held, size = [], 0
        for batch in slices(batches, 1000):
            number, doc_id = batch.column("number"), batch.column("doc_id").cast(pa.int64())
            for first, encoded in blocks(batch.column("text").to_pylist()):
                w = words(encoded, lower=True)
                ids = classes_of(w.hash, vocabulary, rank)
                doc = np.repeat(np.arange(len(encoded)), w.counts)
                laid, place = _laid(ids, doc)
                logs = np.zeros(len(ids))
                for s in range(0, len(ids), 16384):
                    logs[s : s + 16384] = log_probability(p, _around(laid, place[s : s + 16384]), ids[s : s + 16384])
                shared = np.flatnonzero(ids >= OWN)
                logs[shared] -= log_sizes[ids[shared]]
                total = np.concatenate(([0.0], np.cumsum(logs)))
                own = number.slice(first, len(encoded)).to_numpy()
                one, n = _distinct(doc[shared], w.hash[shared])
                one = shared[one]
                yield _rows(
                    part=(mix(own) % np.uint64(parts)).astype(np.int64),
                    number=own,
                    doc_id=doc_id.slice(first, len(encoded)),
                    n_tokens=w.counts.astype(np.int64),
                    own=total[w.first[1:]] - total[w.first[:-1]],
                )
                held.append((w.hash[one], n, own[doc[one]]))
                size += len(one)
                if size >= DEALT:
                    yield _words_by_part(parts, held)
                    held, size = [], 0
        if size:
            yield _words_by_part(parts, held)

    numbered = docs.select(F.monotonically_increasing_id().alias("number"), "doc_id", "text")
    rows = counts.mapInArrow(_pack_counts(parts), _MEETING_DDL).unionByName(numbered.mapInArrow(run, _MEETING_DDL))
    by_part = lambda df: df.repartition(tasks, "part").sortWithinPartitions("part")
    scored = by_part(by_part(rows).mapInArrow(_meet(parts), _MEETING_DDL)).mapInArrow(_scores, "doc_id bigint, n_tokens bigint, score double")
    mean = F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "score", mean.alias("mean_score"))
