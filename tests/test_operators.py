import random

import numpy as np
import pytest

from noteweave.operators import catalogue as C
from noteweave.operators import matching as M
from noteweave.operators import notes as N
from noteweave.operators import retrieval as R
from noteweave.operators import store as S


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    docs = [(i, [rng.choice(words) for _ in range(rng.randint(0, 12))]) for i in range(40)]
    asked = [(i, [rng.choice(words) for _ in range(3)]) for i in range(10)]
    n, avg = len(docs), np.mean([len(t) for _, t in docs])
    df = {w: sum(w in t for _, t in docs) for w in words}
    raw = {w: np.log(n - k + 0.5) - np.log(k + 0.5) for w, k in df.items() if k}
    idf = {w: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for w, v in raw.items()}
    want = {}
    for q, qt in asked:
        for d, dt in docs:
            s = sum(idf[w] * dt.count(w) * 2.5 / (dt.count(w) + 1.5 * (0.25 + 0.75 * len(dt) / avg)) for w in qt if w in dt)
            if s > 0:
                want[q, d] = s
    got = {(r["query_id"], r["row_id"]): r["score"] for r in R.bm25(spark.createDataFrame(asked, "query_id long, tokens array<string>"), spark.createDataFrame(docs, "row_id long, tokens array<string>")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_vector_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8))
    v[5] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, 2.0])], "id long, vec array<double>")
    got = R.vector_search(rows.where("id % 50 = 0"), rows, 5).collect()
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-30)[:, None]
    for q in range(0, 700, 50):
        s = np.round(unit[q] @ unit.T, 6)
        want = sorted(range(700), key=lambda i: (-s[i], i))[:5]
        assert [r["row_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_hybrid_one_side_only(spark):
    lex = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.5)], "query_id long, row_id long, lexical double")
    sem = spark.createDataFrame([(1, 1, 0.5), (1, 3, 1.0)], "query_id long, row_id long, semantic double")
    got = {r["row_id"]: (r["score"], r["provenance"]) for r in R.fuse(lex, sem, 10).collect()}
    assert got == {1: (0.62, "hybrid"), 2: (0.425, "bm25"), 3: (0.85, "vector")}


def test_catalogue_merge_and_conflicts(spark):
    rows = spark.createDataFrame(
        [(2, "I50.21", "Second", "0", None, None, "b; c"), (1, "i5021", "First", "1", "x", "Not I50.22 (I50.22)", "a; b"), (3, "", "No code", "1", None, None, None), (4, "E11.9", "  ", "1", None, None, None)],
        "row_id long, code string, description string, is_valid_billable string, inclusion_terms string, exclusion_terms string, synonyms string",
    )
    std = C.standard_rows(rows)
    got = C.merge_duplicates(std).collect()
    assert [(r["clean"], r["description"], r["synonyms"], r["n_rows"]) for r in got] == [("I5021", "First", ["a", "b", "c"], 2)]
    s = C.ingestion_stats(std).first()
    assert (s["n_rows"], s["n_malformed"], s["n_duplicates"]) == (4, 2, 1)
    coded = spark.createDataFrame([(1, "I5021"), (1, "I5022"), (2, "I5022")], "group_id int, clean string")
    assert [tuple(r) for r in C.exclusion_conflicts(coded, C.exclusion_edges(rows)).collect()] == [(1, "I5021", "I5022")]


def test_family_falls_back(spark):
    cat = spark.createDataFrame([("K3181",), ("K3182",), ("K35",)], "clean string")
    got = sorted(map(tuple, C.by_family(spark.createDataFrame([("K318",), ("K31811",)], "prefix string"), cat).collect()))
    assert got == [("K318", "K3181"), ("K318", "K3182"), ("K31811", "K3181"), ("K31811", "K3182")]


def test_sections_and_as_of(spark):
    docs = spark.createDataFrame([(1, "intro\nHOSPITAL COURSE:\nfine\nVERLAUF\ngut"), (2, None), (3, "")], "id long, text string")
    got = [(r["id"], r["section"], r["start_char"], r["end_char"]) for r in N.sections(docs).orderBy("id", "start_char").collect()]
    assert got == [(1, "GENERAL", 0, 6), (1, "HOSPITAL_COURSE", 6, 28), (1, "HOSPITAL_COURSE", 28, 39), (3, "GENERAL", 0, 0)]
    at = spark.createDataFrame([(10, 1, 0), (11, 1, 6), (12, 1, 27)], "key long, id long, at int")
    assert {r["key"]: r["section"] for r in N.section_at(at, N.sections(docs)).collect()} == {10: "GENERAL", 11: "HOSPITAL_COURSE", 12: "HOSPITAL_COURSE"}


def test_one_primary(spark, sf):
    m = N.latest_mentions(spark.read.parquet(f"{sf}/diagnosis_candidates.parquet"))
    r = N.rank_roles(m)
    assert r.where("final_role = 'PRIMARY'").groupBy("document_id").count().where("count > 1").count() == 0
    assert r.groupBy("document_id", "position").count().where("count > 1").count() == 0


def test_concept_scores(spark):
    rows = [
        ("I50.21", "Acute systolic (congestive) heart failure", "acute systolic heart failure", 1.0),
        ("M17.11", "Osteoarthritis of right knee", "osteoarthritis of left knee", 0.0),
        ("I10", "Essential hypertension", "htn", None),
        ("I10", "Essential hypertension", "fracture", 0.0),
        ("I10", None, "x", 0.0),
    ]
    df = spark.createDataFrame([(i, c, d, t, None) for i, (c, d, t, _) in enumerate(rows)], "i int, code string, description string, concept string, evidence string")
    for r in M.score_pairs(df).collect():
        want = rows[r["i"]][3]
        assert 0 <= r["score"] <= 1 and (want is None and r["score"] > 0.5 or r["score"] == want)


def test_queries_that_differ_in_unknown_words_are_searched_once(spark):
    docs = spark.createDataFrame([(1, ["sprain", "knee"]), (2, ["cancer", "lung"]), (3, ["knee"])], "row_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["zzq", "knee"]), (2, ["knee", "yyx"]), (3, ["knee"]), (4, ["carcinoma", "lungs"]), (5, ["zzq"])], "query_id long, tokens array<string>")
    seen = R.kinds(asked, docs)
    got = {r["query_id"]: r["tokens"] for r in seen.collect()}
    assert got == {1: ["", "knee"], 2: ["", "knee"], 3: ["knee"], 4: ["carcinoma", "lungs"], 5: [""]}
    of = lambda q: sorted(map(tuple, R.lexical(q, docs, 10).collect()))
    assert of(seen) == of(asked) and len(of(asked)) == 6


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, status string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "document_id int, status string")
    assert sorted(map(tuple, S.upsert(old, new, "document_id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    left = S.delete_cascade(new, "document_id", docs=old)
    assert [tuple(r) for r in left["docs"].collect()] == [(1, "a")]


@pytest.mark.parametrize("name", ["search", "page"])
def test_empty_store(spark, name):
    empty = spark.createDataFrame([], "id long, document_id string, filename string, status string, text string, created_at timestamp, word_count int")
    assert (S.search(empty, "x", "NEW", empty) if name == "search" else S.page(empty, 5, 2)).count() == 0
    m = spark.createDataFrame([], "diagnosis_id string, role string, is_authorized boolean")
    t = S.totals(empty, m).first()
    assert t["n_documents"] == 0 and t["authorized_percent"] == 0.0 or t["authorized_percent"] is None


def test_sessions(spark):
    e = spark.sql("select 1L user_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) ts from values (0), (10), (60) v(m)")
    assert tuple(S.run_sessions(e).first()) == (1, 2, 2)
