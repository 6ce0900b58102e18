from noteweave import pipeline
from noteweave.operators import notes
from noteweave.streaming import notes as stream


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/clinical_documents.parquet").select("id", "document_id", "text", "received_at")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.write_sections(stream.read_stream(spark, str(tmp_path / "in"), docs.schema, 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    cols = ["id", "section_no", "section", "start_char", "end_char"]
    got, want = spark.read.parquet(str(tmp_path / "out")).select(cols), notes.sections(docs).select(cols)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_windows_with_late_data(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    s = stream.event_rate(stream.read_stream(spark, str(tmp_path / "in"), e.schema), late="1000 days")
    q = s.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").selectExpr("sum(n)").first()[0] == e.count()


def test_pipeline(spark, sf, tmp_path):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    r = pipeline.run(spark, t("clinical_documents"), t("diagnosis_candidates"), t("sample_hospital_icd"), str(tmp_path / "out"))
    assert r.error is None and set(r.tables) == {"parsing", "extraction", "retrieval", "classification", "serialization"} and r.ms["total_ms"] > 0
    bad = pipeline.run(spark, t("region"), t("diagnosis_candidates"), t("sample_hospital_icd"))
    assert bad.error and bad.error.startswith("parsing")
