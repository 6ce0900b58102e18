import itertools

import pytest
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.operators import catalogue, extraction, mentions, rules, splitters
from noteweave.plans import note_queries
from noteweave.sources import index


def test_code_checks(spark):
    cat = spark.createDataFrame([("I50", "Heart failure", False), ("I5021", "Acute systolic heart failure", True), ("S72001", "Fracture of right femur", True)], "clean string, description string, billable boolean")
    sel = spark.createDataFrame([(1, "Z99.9999", 0.99, "x"), (2, "I50", 0.85, "heart failure"), (3, "I50.21", 0.9, "acute heart failure"), (4, None, None, "x"), (5, "I50.21", 0.1, "x"), (6, "S72.001", 0.9, "left femur fracture"), (7, "S72.001", None, "femur fracture"), (8, " ", 0.9, None)], "key long, code string, score double, term string")
    got = {r["key"]: r["outcome"] for r in rules.validate_codes(sel, cat).collect()}
    assert got == {1: rules.INVALID, 2: rules.HEADER, 3: rules.VALID, 4: rules.NO_CANDIDATE, 5: rules.LOW, 6: rules.SIDE, 7: rules.VALID, 8: rules.NO_CANDIDATE}
    assert rules.validate_codes(sel.limit(0), cat).count() == 0


def test_encounter_checks(spark):
    coded = spark.createDataFrame([("a", "I10", "PRIMARY"), ("a", "E119", "PRIMARY"), ("b", "I10", "SECONDARY"), ("b", "I150", None), ("c", "I10", "PRIMARY"), ("c", "I10", "PRIMARY")], "group_id string, clean string, role string")
    edges = spark.createDataFrame([("I150", "I10")], "clean string, other string")
    got = sorted(map(tuple, rules.validate_encounter(coded, edges).collect()))
    assert got == [("a", "MULTIPLE_PRIMARY", 2), ("b", "EXCLUDED_PAIR", 1), ("b", "NO_PRIMARY", 1)]


def test_pattern_table(spark):
    table = spark.createDataFrame([(2, "heart", "CARDIAC"), (1, "heart failure", "FAILURE"), (3, "lung", "LUNG")], "ordinal int, pattern string, outcome string")
    rows = spark.createDataFrame([("Heart failure",), ("heart block",), ("skin",), (None,), ("skin",)], "term string")
    assert {r["term"]: r["outcome"] for r in rules.match_patterns(rows, "term", table).collect()} == {"Heart failure": "FAILURE", "heart block": "CARDIAC", "skin": None}
    assert {r["outcome"] for r in rules.match_patterns(rows, "term", table.limit(0)).collect()} == {None}


@pytest.mark.parametrize(
    ("term", "want"),
    [
        ("pneumonia and acute kidney injury", ["pneumonia", "acute kidney injury"]),
        ("nausea and vomiting", ["nausea and vomiting"]),
        ("carcinoma metastatic to liver and the bone", ["carcinoma metastatic to liver", "carcinoma metastatic to bone"]),
        ("anaemia secondary to gastric ulcer", ["anaemia", "gastric ulcer"]),
        ("pneumonia with sepsis", ["pneumonia", "sepsis"]),
        ("cholecystitis with obstruction", ["cholecystitis with obstruction"]),
        ("hypertension, type 2 diabetes mellitus; asthma", ["hypertension", "type 2 diabetes mellitus", "asthma"]),
        ("fracture of hip and wrist", ["fracture of hip and wrist"]),
        ("hernia (left and right)", ["hernia (left and right)"]),
        ("", []),
    ],
)
def test_compound(term, want):
    assert splitters.split_compound(term) == want


@pytest.mark.parametrize(("term", "want"), [("essential hypertension chronic asthma", ["essential hypertension", "chronic asthma"]), ("acute kidney injury", ["acute kidney injury"]), ("diabetes mellitus type 2", ["diabetes mellitus type 2"]), ("x", ["x"])])
def test_adjacent(term, want):
    assert splitters.split_adjacent(term) == want


def test_head_and_attributes(spark):
    rows = spark.createDataFrame([("sepsis - treated with fluids",), ("breast carcinoma grade II stage IIA ER positive",), (None,), ("anaemia (Hb 7.1 g/dl)",)], "t string")
    c = F.col("t")
    got = [(r["h"], r["g"], r["p"]) for r in rows.select(splitters.head_of(c).alias("h"), splitters.attributes_of(c)["grade"].alias("g"), splitters.without_attributes(c).alias("p")).collect()]
    assert got == [("sepsis", None, "sepsis - treated with fluids"), ("breast carcinoma grade II stage IIA ER positive", "grade II", "breast carcinoma"), (None, None, None), ("anaemia (Hb 7.1 g/dl)", None, "anaemia")]


NOTE = """CHIEF COMPLAINT: chest pain
HISTORY OF PRESENT ILLNESS:
Admitted with acute pneumonia on Monday. No evidence of sepsis; suspected embolism of the lung.
PAST MEDICAL HISTORY:
Old hip fracture
Anxiety and colitis, on treatment
HOSPITAL COURSE:
He developed acute pneumonia, but no evidence of abscess.
DISCHARGE DIAGNOSES:
1. Pneumonia
2. Colitis
MEDICATIONS:
something for infection
"""


def test_phases(spark):
    docs = spark.createDataFrame([(1, NOTE, "x"), (2, None, "x"), (3, "", "x"), (4, NOTE, "x")], "id long, text string, term string")
    got = {(r["id"], r["term"]): r for r in extraction.with_primary(extraction.mentions_of(docs)).collect()}
    assert {i for i, _ in got} == {1, 4}
    one = {t: r for (i, t), r in got.items() if i == 1}
    assert one["pneumonia"]["final_role"] == "PRIMARY" and one["pneumonia"]["phase"] == "diagnosis_list"
    assert one["sepsis"]["final_role"] == "RULED_OUT" and one["abscess"]["polarity"] == "NEGATED"
    assert one["acute pneumonia"]["acuity"] == "ACUTE" and one["acute pneumonia"]["n_mentions"] == 2
    assert one["old hip fracture"]["role"] == "HISTORICAL" and not any("something" in t for t in one)
    assert extraction.mentions_of(docs.limit(0)).count() == 0


def test_mention_by_clause_and_longest(spark):
    cat = spark.createDataFrame([("J18", "Pneumonia"), ("N17", "Acute kidney failure"), ("N19", "Kidney failure"), ("R10", "Боль в животе")], "code string, description string")
    docs = spark.createDataFrame([(1, "No evidence of pneumonia; acute kidney failure confirmed. Боль в животе?")], "id long, text string")
    got = {(r["code"], r["polarity"]) for r in mentions.longest(mentions.extract(docs, cat)).collect()}
    assert got == {("J18", "NEGATED"), ("N17", "AFFIRMED"), ("R10", "UNCERTAIN")}


def _broadcasts_notes(df) -> bool:
    """Whether a broadcast of the plan holds notes (taken apart in Python)."""
    plan = [(len(x) - len(x.lstrip(" :+-")), x) for x in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    assert any("ArrowEvalPython" in x for _, x in plan)
    return any("BroadcastExchange" in x and any("ArrowEvalPython" in y for _, y in itertools.takewhile(lambda z: z[0] > depth, plan[k + 1 :])) for k, (depth, x) in enumerate(plan))  # noqa: B023


def test_notes_words_are_never_broadcast(spark, tmp_path):
    rows = spark.createDataFrame([(f"A{k}", f"Disorder number {k} of the left side") for k in range(3000)], "code string, description string")  # longer than the notes
    rows.coalesce(1).write.parquet(f"{tmp_path}/entries")
    docs = spark.createDataFrame([(1, "No evidence of disorder number 7 of the left side."), (2, "Disorder number 8 of the right side.")], "id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    found = mentions.extract(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/entries"))
    assert not _broadcasts_notes(found)
    assert [(r["id"], r["code"], r["polarity"]) for r in found.collect()] == [(1, "A7", "NEGATED")]
    counted = mentions.longest(found).groupBy("section", "polarity").count()  # as mention_sections does
    assert not _broadcasts_notes(counted) and [tuple(r) for r in counted.collect()] == [("GENERAL", "NEGATED", 1)]


def test_mention_sections_counts_without_broadcast_notes(spark, tmp_path):
    rows = spark.createDataFrame([(f"A{k}", f"Disorder number {k} of the left side") for k in range(3000)] + [("B1", "Left side")], "code string, description string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/sample_hospital_icd.parquet")
    text = "No evidence of disorder number 7 of the left side.\nPLAN:\nDisorder number 8 of the left side. Disorder number 9 of the right side.\nLeft side?"
    docs = spark.createDataFrame([(k, text) for k in range(50)], "id long, text string")  # of one text, so that their file is small
    docs.coalesce(1).write.parquet(f"{tmp_path}/clinical_documents.parquet")
    counted = note_queries.mention_sections(spark, str(tmp_path))
    assert {tuple(r) for r in counted.collect()} == {("GENERAL", "NEGATED", 50), ("PLAN", "AFFIRMED", 50), ("PLAN", "UNCERTAIN", 50)}
    assert not _broadcasts_notes(counted)  # neither in the first plan nor in the one that ran


def test_index(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/sample_hospital_icd.parquet")
    made = index.build_index(rows)
    folder = str(tmp_path / "index")
    assert index.load_index(spark, folder) is None
    kept = index.ensure_index(spark, rows, folder)
    queries = rows.where("description is not null").limit(15).select(F.col("row_id").alias("query_id"), T.clinical_tokens(F.col("description")).alias("tokens"))
    as_set = lambda t: {tuple(r) for r in t.collect()}
    assert as_set(made.search(queries, 5)) == as_set(kept.search(queries, 5))
    assert index.load_index(spark, folder, "1:0:0") is None and index.load_index(spark, folder, index.fingerprint(rows)) is not None
    assert index.ensure_index(spark, rows, folder).docs.count() == made.docs.count()


def test_catalogue_is_unchanged_by_order(spark):
    rows = spark.createDataFrame([(2, "I10", "b", "1", None, None, "x"), (1, "I10", "a", "0", None, None, "y")], "row_id long, code string, description string, is_valid_billable string, inclusion_terms string, exclusion_terms string, synonyms string")
    one = catalogue.merge_duplicates(catalogue.standard_rows(rows)).first()
    assert one["description"] == "a" and one["synonyms"] == ["y", "x"]
