from noteweave import pipeline
from noteweave.functions import text as T
from noteweave.operators import catalogue as C
from noteweave.operators import retrieval as R
from noteweave.operators import terms as X
from noteweave.plans import retrieval_queries, term_queries

CATALOGUE = "row_id long, code string, description string, is_valid_billable string, inclusion_terms string, exclusion_terms string, synonyms string"


def test_inclusion_terms_are_merged_and_searched(spark):
    rows = [(1, "A01.1", "First thing", "1", "p; q", None, None), (2, "A011", "Second", "1", "q; torpid quillwort", None, "s"), (3, "B02.1", "Other matter", "1", None, None, None), (4, "C03.1", "Third matter", "1", None, None, None)]
    cat = spark.createDataFrame(rows, CATALOGUE)
    got = {r["clean"]: r["inclusion_terms"] for r in C.merge_duplicates(C.standard_rows(cat)).collect()}
    assert got == {"A011": ["p", "q", "torpid quillwort"], "B021": [], "C031": []}
    found = spark.createDataFrame([("d1", "First quillwort")], "document_id string, raw_term string")
    docs = spark.createDataFrame([], "id long, document_id string, text string")
    hit = pipeline.code_mentions(found, cat, docs).first()
    plain = pipeline.code_mentions(found, cat.drop("inclusion_terms").selectExpr("*", "cast(null as string) inclusion_terms"), docs).first()
    assert hit["code"] == "A01.1" and hit["final"] > plain["final"]


def test_lines_corroborate_terms_of_their_document(spark):
    cat = spark.createDataFrame([(1, "A01.1", "Quillwort of left knee", "1", None, None, None), (2, "A01.2", "Quillwort of right knee", "1", None, None, None), (3, "B02.1", "Other matter", "1", None, None, None), (4, "C03.1", "Third", "1", None, None, None), (5, "D03.1", "Fourth", "1", None, None, None)], CATALOGUE)
    found = spark.createDataFrame([("m1", "d1", "Quillwort knee"), ("m2", "d2", "quillwort knee"), ("m3", "d3", "quillwort knee"), ("m4", None, "quillwort knee")], "diagnosis_id string, document_id string, raw_term string")
    docs = spark.createDataFrame([(1, "d1", "Seen today.\nQuillwort on the left. Well."), (2, "d2", "Quillwort on the right"), (3, "d3", None)], "id long, document_id string, text string")
    snippets = spark.createDataFrame([("m3", "right side", 0)], "diagnosis_id string, quote string, start_char int")
    got = {r["document_id"]: r["code"] for r in pipeline.code_mentions(found, cat, docs, snippets).collect()}
    assert got == {"d1": "A01.1", "d2": "A01.2", "d3": "A01.2", None: "A01.1"}
    named = spark.createDataFrame([("d1", "acute quillwort of torpid knee", ["quillwort on the left. and more"])], "document_id string, term string, quotes array<string>")
    text = spark.createDataFrame([(1, "d1", "Quillwort on the left.\nA knee\nA KNEE of sorts\nTorpid and well\nNothing here")], "id long, document_id string, text string")
    assert X.corroborate(named, text).first()["evidence"] == "quillwort on the left. and more | A knee | Torpid and well"


def test_variations_of_a_query(spark):
    asked = spark.createDataFrame([(1, "Acute primary hypertension", None), (2, "kidney stone", "stone in the renal pelvis"), (3, "plain", ""), (4, None, None)], "query_id long, text string, evidence string")
    got = {}
    for r in X.query_variations(asked).collect():
        got.setdefault(r["query_id"], []).append(r["variation"])
    assert got[1][:4] == ["essential primary hypertension", "essential hypertension", "hypertension", "primary hypertension"]
    assert "renal calculus" in got[2] and "stone renal" in got[2] and got.keys() == {1, 2}


def test_retry_reaches_vectors_variations_and_evidence(spark):
    names = ["Quillwort torpor", "Essential hypertension", "Zanthic lesion", "Mossy bracket", "Fennel drift", "Quiet harbour", "Thistle gap", "Juniper fold"]
    s = spark.createDataFrame([(i, f"A0{i}.1", n) for i, n in enumerate(names)], "row_id long, code string, description string")
    docs = s.select("row_id", T.clinical_tokens(s["description"]).alias("tokens"))
    vectors = R.dense(R.hashed_features(s.selectExpr("row_id as id", "description as text")))
    asked = spark.createDataFrame([(1, "quillworts torpors", ""), (2, "stage 4 primary hypertension", ""), (3, "unheard of matter", "zanthic lesion"), (4, "Mossy bracket", "")], "query_id long, text string, evidence string")
    got = {(r["query_id"], r["row_id"]): (r["score"], r["round"]) for r in R.retry(asked, docs, vectors, s).collect()}
    assert (1, 0) in got and R.bm25(asked.where("query_id = 1").select("query_id", T.clinical_tokens(asked["text"]).alias("tokens")), docs).count() == 0
    assert got[2, 1][1] == 2 and got[3, 2][1] == 3 and got[4, 3][0] >= 0.98


def test_fused_scores_rank_within_chapters(spark, sf):
    lex = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.9)], "query_id long, row_id long, lexical double")
    sem = spark.createDataFrame([(1, 1, 0.9), (1, 3, 1.0), (1, 4, 0.5)], "query_id long, row_id long, semantic double")
    chapter = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B")], "row_id long, chapter string")
    got = sorted((r["chapter"], r["rank"], r["row_id"], r["provenance"]) for r in R.top_k_by_system(R.fused(lex, sem), chapter, 2).collect())
    assert got == [("A", 1, 1, "hybrid"), ("A", 2, 3, "vector"), ("B", 1, 4, "vector")]
    assert {"hybrid", "vector"} <= {r["provenance"] for r in retrieval_queries.hybrid_fused_by_system(spark, sf).collect()}


def test_every_note_with_text_is_split(spark, sf):
    want = {r["id"] for r in spark.read.parquet(f"{sf}/clinical_documents.parquet").where("text is not null").collect()}
    assert {r["id"] for r in term_queries.sentence_split(spark, sf).collect()} == want
