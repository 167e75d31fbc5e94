from glyphward.streaming import gate


def test_gate_passes_clean_documents(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "clean"), (2, "" * 5), (3, "a​"), (4, None)], "doc_id long, text string").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    gate.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect()} == {1, 3, 4}
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == 2


def test_findings_by_day(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' AS ts, 1L AS doc_id, 'a​' AS text UNION ALL SELECT TIMESTAMP_NTZ'2024-01-01 11:00:00', 2L, 'b​'").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp_ntz, doc_id long, text string").parquet(source)
    q = gate.findings_by_day(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["rule"], r["n"]) for r in spark.table("days").collect()] == [("UNICODE.ZERO_WIDTH", 2)]
