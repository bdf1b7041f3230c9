"""Document quality by hierarchical empirical Bayes over sites.

A logistic classifier on counts of a text (those of the quality rules) gives each document's
evidence, a log likelihood ratio of good to bad. Expected numbers of good documents are summed
by path and by host; the rate of a host shrinks to the global rate and that of a path to its host's, each
the more the fewer documents it has, with strengths fitted by moments to how much rates differ
beyond chance. A document's posterior joins its path's rate as prior with its own evidence.

The classifier is fitted on at most about ``train_rows`` labelled documents picked by a hash of doc_id; sums,
strengths and posteriors cover all documents.

Nulls and edge cases: a null text counts as one without words; null hosts form one host, null paths one
path of their host; a null doc_id is kept as null and not learnt from; of repeated labels the largest counts;
without labels of both kinds the evidence is 0 and all get the rate 0.5; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.rules import features
from quire.llm.workspace import slices, stored

#: Largest number of paths whose rates are broadcast (under 200 bytes each).
BROADCAST_PATHS = 100_000
SALTS = 64
_RATIOS = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "n_letters"), ("n_exclaim", "n_words"), ("n_distinct", "n_words"), ("n_marked", "n_words"), ("n_letter_bytes", "n_word_bytes"))


def design(texts: list[str | None]) -> np.ndarray:
    """The classifier's inputs for each text: ratios of counts and the logarithm of the length."""
    f = features(texts)
    columns = [f[a] / np.maximum(f[b], 1) for a, b in _RATIOS]
    return np.stack([*columns, np.log1p(f["n_words"])], axis=1)


class Evidence:
    """Ridge logistic regression by Newton steps."""

    def __init__(self, x: np.ndarray, good: np.ndarray, ridge: float = 1.0):
        self.ok = bool(len(good)) and 0 < good.sum() < len(good)
        if not self.ok:
            return
        self.centre, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = self._expand(x)
        self.base = np.log(good.mean() / (1 - good.mean()))
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (good - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good to bad, within +-8."""
        if not self.ok:
            return np.zeros(len(x))
        return np.clip(self._expand(x) @ self.w - self.base, -8, 8)


def _strength(groups: DataFrame, rate: Column) -> float:
    """How many documents the rate above counts for, by moments of (n, good, rate above) of all groups."""
    r = groups.select(F.col("n").cast("double").alias("n"), F.col("good"), rate.alias("m")).select("n", "m", (F.col("good") / F.col("n")).alias("p"))
    got = r.agg(F.sum("n"), F.sum(F.col("n") ** 2), F.sum(F.col("n") * (F.col("p") - F.col("m")) ** 2), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))), F.count("*")).first()
    if not got[0] or got[4] < 2:
        return 10.0
    total, squares, spread, chance, k = map(float, got)
    variance = chance / total
    between = (spread - (k - 1) * variance) / max(1e-9, total - squares / total)
    if between <= 0:
        return 1e6
    return float(np.clip(variance / between - 1, 1.0, 1e6))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, train_rows: int = 20_000, seed: int = 3) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, posterior, kept) of each document."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(train_rows / n * (1 << 30)))
    width = len(_RATIOS) + 1

    def inputs(batches):
        for batch in slices(batches, 1000):
            x = design(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("good").cast(pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), width).cast(pa.list_(pa.float64()))], names=["good", "x"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about train_rows ids
    got = chosen.select("text", "good").mapInArrow(inputs, "good bigint, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, width)
    model = Evidence(x, (got.column("good").to_numpy() > 0).astype(float))
    rate = float(np.clip((got.column("good").to_numpy() > 0).mean(), 0.01, 0.99)) if model.ok else 0.5

    def evidence(batches):
        for batch in slices(batches, 1000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("host"), batch.column("path"), pa.array(model(design(batch.column("text").to_pylist())))], names=["doc_id", "host", "path", "evidence"])

    picked = docs.select("doc_id", "text", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    scored = stored(picked.mapInArrow(evidence, "doc_id bigint, host string, path string, evidence double"), "evidence")
    expected = 1 / (1 + F.exp(-(F.lit(float(np.log(rate / (1 - rate)))) + F.col("evidence"))))
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(expected).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    totals = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = float(np.clip((totals[1] or 0) / (totals[0] or 1), 0.001, 0.999)) if totals[0] else rate
    pull = _strength(hosts, F.lit(overall))
    host_rate = hosts.select("host", ((F.col("good") + pull * overall) / (F.col("n") + pull)).alias("host_rate"))
    under = stored(paths.join(host_rate, "host"), "under")
    pull_path = _strength(under, F.col("host_rate"))
    rates = under.select("host", "path", "host_rate", ((F.col("good") + pull_path * F.col("host_rate")) / (F.col("n") + pull_path)).alias("path_rate"))
    if rates.count() <= BROADCAST_PATHS:
        out = scored.join(F.broadcast(rates), ["host", "path"])
    else:  # a hot path's documents go to several tasks
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    posterior = 1 / (1 + F.exp(-(F.log(F.col("path_rate") / (1 - F.col("path_rate"))) + F.col("evidence"))))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", posterior.alias("posterior")).withColumn("kept", F.col("posterior") >= 0.5)
