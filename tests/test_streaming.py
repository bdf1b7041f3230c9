from quire.streaming.progress import append_segments


def test_replay_adds_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20).selectExpr("id % 2 as doc_id", "id as seg_index", "'x' as text").write.parquet(src)
    for attempt in ("a", "b"):  # a lost checkpoint replays all
        stream = spark.readStream.schema("doc_id bigint, seg_index bigint, text string").parquet(src)
        append_segments(stream, out, str(tmp_path / attempt)).awaitTermination(60)
    assert spark.read.parquet(out).count() == 20
