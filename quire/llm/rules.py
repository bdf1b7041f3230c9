"""Quality rules as weak supervision.

Each rule votes good (2) or bad (0) on a document or abstains (1). Expectation-maximisation
over all documents estimates, for each rule, how often it votes what on good and on bad
documents (its accuracies), and the share of good documents; a document's quality is then the
posterior probability given its votes, and replaces a filter in which every rule must pass.
Documents with equal votes have equal posteriors, so the estimation runs on the counts of vote
patterns: all documents count, and the driver gets 3**10 rows at most.

A base rule stands beside the votes: documents with under 50 words, or with over half of their
words in 3-word windows that repeat, fail whatever the posterior.

Nulls and edge cases: a null text counts as one without words and fails the base rule; a null
doc_id is kept as null; repeated rows are judged alike; an empty table gives an empty result;
other columns are ignored, or passed through by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.textvec import blocks, mix, running_hash, windows, words
from quire.llm.workspace import slices, stored

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Distinct words are counted in runs of so many words.
VARIETY_WORDS = 100
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: (numerator, denominator, good from, good to, bad below, bad above): a rule abstains between.
RULES = {
    "length": ("n_words", None, 100, 50_000, 50, 200_000),
    "word_length": ("word_chars", "n_words", 3.5, 9.0, 2.0, 14.0),
    "symbols": ("n_symbols", "n_words", 0.0, 0.03, -1, 0.1),
    "repeated_lines": ("n_dup_lines", "n_lines", 0.0, 0.05, -1, 0.3),
    "repeated_words": ("n_repeat_words", "n_words", 0.0, 0.1, -1, 0.3),
    "capitals": ("n_upper", "n_letters", 0.0, 0.1, -1, 0.3),
    "exclamation": ("n_exclaim", "n_words", 0.0, 0.02, -1, 0.2),
    "variety": ("n_distinct", "n_words", 0.4, 1.0, 0.2, 2.0),
    "marked_words": ("n_marked", "n_words", 0.0, 0.03, -1, 0.1),
    "letters": ("n_letter_bytes", "n_word_bytes", 0.93, 1.0, 0.8, 2.0),
}


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(total[bounds])


def features(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts for each text, from one byte buffer for each block of texts."""
    parts: list[dict[str, np.ndarray]] = []
    for _, encoded in blocks(texts):
        w = words(encoded, lower=False)
        d, docs = w.data, len(encoded)
        inside = np.zeros(len(d) + 1, dtype=np.int8)
        inside[w.start] += 1
        inside[w.end] -= 1
        in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        point = (d & 0xC0) != 0x80
        line_end = np.flatnonzero(d == 0x0A)
        line_start = np.concatenate(([0], line_end[:-1] + 1))
        has_word = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
        line_start, line_end = line_start[has_word], line_end[has_word]
        line_doc = np.searchsorted(w.doc_start, line_start, side="right") - 1
        line_key = mix(running_hash(d, line_start, line_end) + mix(line_doc.astype(np.uint64)))
        n_lines = np.bincount(line_doc, minlength=docs)
        _, first = np.unique(line_key, return_index=True)
        word_doc = np.repeat(np.arange(docs), w.counts)
        three = windows(w.hash, 3)
        same_doc = word_doc[: len(three)] == word_doc[2:] if len(three) else np.zeros(0, dtype=bool)
        repeated = np.zeros(len(w.hash), dtype=bool)
        if len(three):
            code, names = pd.factorize(mix(three + mix(word_doc[: len(three)].astype(np.uint64))))
            often = (np.bincount(code[same_doc], minlength=len(names))[code] >= 2) & same_doc
            for k in range(3):
                repeated[k : k + len(three)] |= often
        run = (np.arange(len(word_doc)) - w.first[:-1][word_doc]) // VARIETY_WORDS  # so that the measure does not fall with length
        code, names = pd.factorize(mix(w.hash + mix(word_doc.astype(np.uint64) + (run.astype(np.uint64) << np.uint64(32)))))
        seen_first = np.zeros(len(names), dtype=np.int64)
        seen_first[code[::-1]] = word_doc[::-1]
        signs = np.concatenate(([0], np.cumsum(_SYMBOL[d], dtype=np.int64)))
        marked = signs[w.end] > signs[w.start]
        b = w.doc_start
        parts.append(
            {
                "n_words": w.counts,
                "word_chars": _per_doc(in_word & point, b),
                "n_symbols": _per_doc(_SYMBOL[d], b),
                "n_dup_lines": n_lines - np.bincount(line_doc[first], minlength=docs),
                "n_repeat_words": _per_doc(repeated, w.first),
                "n_lines": n_lines,
                "n_upper": _per_doc(_UPPER[d], b),
                "n_letters": _per_doc(_ALPHA[d], b),
                "n_exclaim": _per_doc(d == 0x21, b),
                "n_distinct": np.bincount(seen_first, minlength=docs) if len(names) else np.zeros(docs, dtype=np.int64),
                "n_marked": _per_doc(marked, w.first),
                "n_letter_bytes": _per_doc(_ALPHA[d] | (d >= 0x80), b),
                "n_word_bytes": _per_doc(in_word, b),
            }
        )
    if not parts:
        return {k: np.zeros(0, dtype=np.int64) for k in [*BASE, "n_lines", "n_upper", "n_letters", "n_exclaim", "n_distinct", "n_marked", "n_letter_bytes", "n_word_bytes"]}
    return {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in parts[0]}


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """The pattern of all rules' votes on each document, as one number to base 3."""
    out = np.zeros(len(f["n_words"]), dtype=np.int64)
    for k, (top, bottom, good_from, good_to, bad_below, bad_above) in enumerate(RULES.values()):
        below = np.maximum(f[bottom], 1) if bottom else 1
        x = f[top] / below
        vote = np.full(len(out), ABSTAIN)
        vote[(x >= good_from) & (x <= good_to)] = GOOD
        vote[(x < bad_below) | (x > bad_above)] = BAD
        if bottom:
            vote[f[bottom] == 0] = ABSTAIN
        out += vote * 3**k
    return out


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


@dataclass
class LabelModel:
    """Estimates of expectation-maximisation: share of good documents, and for class (bad, good),
    rule and vote the probability of that vote."""

    share: float
    vote: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        digits = patterns[:, None] // 3 ** np.arange(len(RULES)) % 3
        logs = np.log(self.vote)[:, np.arange(len(RULES)), digits].sum(axis=2)
        gap = logs[0] - logs[1] + np.log1p(-self.share) - np.log(self.share)
        return 1 / (1 + np.exp(np.clip(gap, -700, 700)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Fit to the counts of vote patterns. It starts from documents being bad the likelier the more rules say so."""
    R = len(RULES)
    digits = patterns[:, None] // 3 ** np.arange(R) % 3
    good = 0.95 * 0.2 ** (digits == BAD).sum(axis=1)
    model, weight = LabelModel(0.5, np.full((2, R, 3), 1 / 3)), counts.astype(float)
    if not len(patterns):
        return model
    for _ in range(rounds):
        total = weight.sum()
        share = (weight @ good + 1) / (total + 2)
        table = np.empty((2, R, 3))
        for c, p in enumerate((weight * (1 - good), weight * good)):
            for v in range(3):
                table[c, :, v] = p @ (digits == v) + 0.5
            table[c] /= table[c].sum(axis=1, keepdims=True)
        model = LabelModel(float(share), table)
        new = model.posterior(patterns)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


def _features_of(batches):
    for batch in slices(batches, 500):
        f = features(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *[pa.array(f[c]) for c in BASE], pa.array(base_failed(f)), pa.array(votes(f))],
            names=["doc_id", *BASE, "base_failed", "pattern"],
        )


_FEATURES = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, pattern bigint"


def fit(rows: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """The model, and the vote patterns that occur, from rows with ``pattern``."""
    got = rows.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    patterns, counts = got.column("pattern").to_numpy(), got.column("n").to_numpy()
    return estimate(patterns, counts), patterns


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, counts, base_failed, quality, kept) of each row; ``quality`` is the posterior."""
    rows = stored(docs.select("doc_id", "text").mapInArrow(_features_of, _FEATURES), "features")
    model, patterns = fit(rows)
    table = docs.sparkSession.createDataFrame(
        pd.DataFrame({"pattern": patterns.astype("int64"), "quality": model.posterior(patterns) if len(patterns) else np.zeros(0)}), "pattern bigint, quality double"
    )
    out = rows.join(F.broadcast(table), "pattern")  # 3 ** 10 rows at most
    return out.select("doc_id", *BASE, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass the base rule with a quality of at least ``least``. The texts
    are read twice, once to estimate and once to filter, and cross no shuffle."""

    def patterns_of(batches):
        for batch in _features_of(batches):
            yield batch.select(["pattern"])

    model, _ = fit(docs.select("doc_id", "text").mapInArrow(patterns_of, "pattern bigint"))

    def run(batches):
        for batch in slices(batches, 500):
            f = features(batch.column("text").to_pylist())
            yield batch.filter(pa.array(~base_failed(f) & (model.posterior(votes(f)) >= least)))

    return docs.mapInArrow(run, docs.schema)
