"""A corpus pipeline of five operators: language, quality, near duplicates, mix, packing.

Every stage reads all that its predecessor kept, as Parquet, and returns the columns of
``documents``, but for the last, which returns the pieces of training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import jaccard, langid, mixing, packing, rules
from quire.llm.tokens import default_vocabulary
from quire.llm.workspace import stored

WEIGHTS = [3, 1, 2]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, or below a score of 0.5, go."""
    return langid.keep_known(docs, langid.train(docs), least_score=0.5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule with a posterior quality of at least 0.5."""
    return rules.keep_good(docs, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a similarity of 0.8 of five-word shingles: the one of the least doc_id,
    also where ids repeat or are null."""
    return jaccard.one_of_each(docs, width=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut is taken whole.
    Rows alike in doc_id and text get the mean of their numbers, rounded up."""
    taken = mixing.mix_sources(docs, WEIGHTS, with_tie=True)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    often = taken.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.ceil(F.avg(copies)).cast("int").alias("_copies")).where("_copies > 0")
    joined = docs.join(often, docs.doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(docs.text) == F.col("_tie")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    pieces = packing.pack_documents(docs, default_vocabulary(), end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: SQL can't express the model stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
