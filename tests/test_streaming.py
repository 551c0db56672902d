from coalign.streaming.incremental import decide_batches


def test_batches_are_decided(spark, tmp_path):
    rows = [(1, 10, 0.9), (2, 10, 0.4), (2, 11, 0.8), (3, 12, 0.1)]
    spark.createDataFrame(rows, "a int, b int, p double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int, b int, p double").parquet(str(tmp_path / "in"))
    config = {"decision": "thresholds", "thresholds": (0.3, 0.5, 0.5)}
    decide_batches(stream, config, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted((r.a, r.b) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 10), (2, 11)]
