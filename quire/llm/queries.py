"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack_documents
    from quire.llm.tokens import default_vocabulary

    pieces = pack_documents(_table(spark, sf_dir, "documents"), default_vocabulary(), end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.bitplanes import encode_to_files, read_ids
    from quire.llm.tokens import default_vocabulary

    folder, manifest = encode_to_files(_table(spark, sf_dir, "documents"), default_vocabulary(), end_id=2)
    return read_ids(spark, folder, manifest)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.langid import held_out, predict_languages, train

    docs = _table(spark, sf_dir, "documents")
    return predict_languages(docs, train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), weights=[3, 1, 2]).select("doc_id", "size", "source_size", "target", "taken")


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of ``documents``: the source is the host, source and language the path."""
    from quire.llm.sitebayes import site_quality

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return site_quality(docs, labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pseudolm import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.vectors import vector_links

    return vector_links(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.rules import judge

    return judge(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_id_planes": op2_id_planes,
        "op3_jaccard": op3_jaccard,
        "op4_language": op4_language,
        "op6_mixing": op6_mixing,
        "op5_site_quality": op5_site_quality,
        "op7_warc": op7_warc,
        "op8_vectors": op8_vectors,
        "op9_pseudo_likelihood": op9_pseudo_likelihood,
        "op10_rules": op10_rules,
    }


def oracle_sql() -> dict[str, str]:
    from quire.llm.mixing import mix_sql
    from quire.llm.vectors import links_sql
    from quire.llm.warc import warc_sql

    return {
        "op6_mixing": mix_sql([3, 1, 2]),
        "op7_warc": warc_sql(),
        "op8_vectors": links_sql(0.98),
    }
