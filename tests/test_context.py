from noteweave import pipeline
from noteweave.operators import context as X
from noteweave.operators import mentions as M
from noteweave.operators import terms as T
from noteweave.sources import documents


def cat(spark):
    return spark.createDataFrame([("A1", "Clemar cyst"), ("A2", "Clemar cyst of left eye"), ("B1", "Stueal haematoma"), ("C1", None)], "code string, description string")


def test_code_text_and_files(spark, tmp_path):
    got = {(r["code"], r["polarity"]) for r in pipeline.code_text(spark, "Clemar cyst of left eye.\nNo evidence of stueal haematoma\nsubclemar cysts", cat(spark)).collect()}
    assert got == {("A2", "AFFIRMED"), ("B1", "NEGATED")}
    (tmp_path / "a.txt").write_text("Clemar cyst")
    (tmp_path / "b.bin").write_bytes(b"%PDF-1.4")
    files = pipeline.code_files(spark, str(tmp_path), cat(spark))
    assert {(r["path"].rsplit("/", 1)[1], r["status"], r["code"]) for r in files.collect()} == {("a.txt", "READY", "A1"), ("b.bin", "NEEDS_OCR", None)}
    assert tuple(pipeline.batch_report(files, 2.0).first()) == (2, 1, 1, 1.0)
    empty = spark.createDataFrame([], "id long, text string")
    assert M.extract(empty, cat(spark)).count() == 0 and M.extract(empty, cat(spark).limit(0)).count() == 0


def test_context(spark):
    rows = [("a", "CONFIRMED", "AFFIRMED", "CURRENT", True), ("b", "UNCERTAIN", "NEGATED", None, None), ("c", None, "NEGATED", None, True), ("d", None, None, "historical", True), ("e", None, None, None, False)]
    m = spark.createDataFrame(rows, "diagnosis_id string, certainty string, assertion_status string, temporality string, is_authorized boolean")
    assert {r["diagnosis_id"]: (r["context"], r["eligible"]) for r in X.assess(m).collect()} == {"a": ("ACTIVE", True), "b": ("AMBIGUOUS", True), "c": ("RULED_OUT", False), "d": ("HISTORICAL", False), "e": ("ACTIVE", False)}


def test_answer(spark):
    df = spark.createDataFrame([('Sure:\n```json\n[{"term": "x", "code": "A1", "confidence": 0.5,},]\n```',), ("no list",), (None,)], "a string")
    got = [r["p"] for r in df.select(X.parse_answer(df["a"]).alias("p")).collect()]
    assert got[0][0]["code"] == "A1" and got[1] is None and got[2] is None


def test_terms(spark):
    df = spark.createDataFrame([(1, "1. h/o dx: HTN (2020) - on treatment?"), (2, "medication refill"), (3, None), (4, "Congenital cyst")], "i int, t string")
    got = {r["i"]: r for r in df.select("i", T.plain_name(df["t"]).alias("n"), T.reject_reason(df["t"]).alias("w"), T.entity_kind(df["t"]).alias("k")).collect()}
    assert got[1]["n"] == "hypertension" and got[2]["w"] == "administrative" and got[3]["w"] == "empty" and got[4]["w"] is None and got[3]["k"] == "NONE"
    lists = spark.createDataFrame([(["Pain", "severe pain in knee", "pain", "", None, "Fever"],), ([],), (None,)], "x array<string>")
    assert [r["y"] for r in lists.select(T.without_repetition("x").alias("y")).collect()] == [["severe pain in knee", "Fever"], [], []]


def test_boxes(spark):
    b = spark.createDataFrame([(1, 5.0, 1.0, "b", 0.5), (1, 1.0, 1.0, "a", None), (1, 0.0, 2.0, "c", 1.0)], "page_id int, x double, y double, text string, confidence double")
    assert tuple(documents.reading_order(b).first()) == (1, "a\nb\nc", 0.75)


def test_checks_read_the_codes_once(spark):
    ranked = spark.createDataFrame([("d1", "m1", "PRIMARY"), ("d1", "m2", "PRIMARY"), ("d2", "m3", "PRIMARY")], "document_id string, diagnosis_id string, final_role string")
    coded = spark.createDataFrame([("a", "A01", 0.5), ("b", "A02", 1.5), ("c", "Z99", -0.1), ("d", None, 0.9), ("e", "A01", None)], "term string, code string, final double")
    cat = spark.createDataFrame([("A01",), ("A02",), ("A02",)], "code string")
    got = X.checks(ranked, coded, cat)
    assert {r["check"]: r["n_failed"] for r in got.collect()} == {"one_primary": 1, "known_code": 2, "score_range": 2}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [term#") == 1
