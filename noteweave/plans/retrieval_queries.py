"""Queries of retrieval: every 50th uploaded row (by id) is searched in the whole catalogue; every 50th vector in all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.functions import values as V
from noteweave.operators import retrieval as R
from noteweave.session import table


def _docs(spark, d):
    s = table(spark, d, "sample_hospital_icd").where("description is not null")
    return s.select("row_id", T.clinical_tokens(F.concat_ws(" ", T.unformat_code(F.col("code")), "description", "synonyms")).alias("tokens"))


def _full_docs(spark, d):
    """Docs with inclusion terms too. The SQL twins of bm25_* and lexical_by_chapter fix the text without them (_docs)."""
    s = table(spark, d, "sample_hospital_icd").where("description is not null")
    return s.select("row_id", T.clinical_tokens(F.concat_ws(" ", T.unformat_code(F.col("code")), "description", "inclusion_terms", "synonyms")).alias("tokens"))


def _asked(spark, d):
    return table(spark, d, "hospital_icd_uploads").where("row_id % 50 = 0 and description is not null")


def _queries(spark, d):
    return _asked(spark, d).select(F.col("row_id").alias("query_id"), T.clinical_tokens(F.col("description")).alias("tokens")).where(F.size("tokens") > 0)


def bm25_idf(spark, d):
    docs = _docs(spark, d)
    return R.idf_table(R.postings(docs), R.corpus_size(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    hits = R.bm25(_queries(spark, d), _docs(spark, d)).withColumn("score", F.round("score", 4))
    return R.top_k(hits, 10).select("query_id", "row_id", "score", "rank")


def bm25_coverage(spark, d):
    return R.lexical(_queries(spark, d), _docs(spark, d), 350)


def hash_embed(spark, d):
    s = table(spark, d, "sample_hospital_icd").where("description is not null")
    return R.hashed_features(s.select(F.col("row_id").alias("id"), F.col("description").alias("text"))).select(F.col("id").alias("row_id"), "idx", F.round("weight", 5).alias("weight"))


def vector_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return R.vector_search(e.where("id % 50 = 0"), e, 10).select("query_id", "row_id", "score", "rank")


def _semantic(spark, d):
    s = table(spark, d, "sample_hospital_icd").where("description is not null").select(F.col("row_id").alias("id"), F.col("description").alias("text"))
    q = _asked(spark, d).select(F.col("row_id").alias("id"), T.expand_abbreviations(F.col("description")).alias("text"))
    return R.semantic(q, R.dense(R.hashed_features(s)), R.WINDOW)


def hybrid_topk(spark, d):
    lex = R.lexical(_queries(spark, d), _full_docs(spark, d), 350)
    return R.fuse(lex, _semantic(spark, d), 10, 0.2).select("query_id", "row_id", "score", "provenance", "rank")


def lexical_by_chapter(spark, d):
    """The best two of each query in each chapter of the catalogue by the lexical score, as its SQL twin says; the window of 350 comes before the chapters."""
    lex = R.lexical(_queries(spark, d), _docs(spark, d), 350)
    chapter = table(spark, d, "sample_hospital_icd").select("row_id", F.col("code").substr(1, 1).alias("chapter"))
    both = lex.withColumnRenamed("lexical", "score").join(chapter, "row_id").withColumn("key", F.concat_ws("|", "query_id", "chapter"))
    return R.top_k(both, 2, by="key").select("query_id", "chapter", "row_id", "score", "rank")


def hybrid_fused_by_system(spark, d):
    """The best two of each query in each chapter by the fused score; the windows of 350 of both sides come before the chapters."""
    both = R.fused(R.lexical(_queries(spark, d), _full_docs(spark, d), R.WINDOW), _semantic(spark, d))
    chapter = table(spark, d, "sample_hospital_icd").select("row_id", F.col("code").substr(1, 1).alias("chapter"))
    return R.top_k_by_system(both, chapter, 2)


def retry_union_max(spark, d):
    """Hybrid rounds with the description, its variations and the row's own inclusion terms and synonyms as evidence."""
    s = table(spark, d, "sample_hospital_icd").where("description is not null")
    asked = _asked(spark, d).select(F.col("row_id").alias("query_id"), F.col("description").alias("text"), F.concat_ws(" ", "inclusion_terms", "synonyms").alias("evidence"))
    vectors = R.dense(R.hashed_features(s.select(F.col("row_id").alias("id"), F.col("description").alias("text"))))
    return R.retry(asked, _full_docs(spark, d), vectors, s.select("row_id", "code", "description"))


def concept_jaccard(spark, d):
    c = table(spark, d, "diagnosis_candidates").where("raw_term is not null and normalized_diagnosis is not null").select("raw_term", "normalized_diagnosis").distinct()
    a, b = F.array_distinct(T.tokens(F.lower("raw_term"), "[a-z0-9]+")), F.array_distinct(T.tokens(F.lower("normalized_diagnosis"), "[a-z0-9]+"))
    shared, whole = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return c.select("raw_term", "normalized_diagnosis", F.round(F.when(whole > 0, shared / whole).otherwise(0.0), 4).alias("jaccard"))


QUERIES = {f.__name__: f for f in (bm25_idf, bm25_topk, bm25_coverage, hash_embed, vector_topk, hybrid_topk, lexical_by_chapter, hybrid_fused_by_system, retry_union_max, concept_jaccard)}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def map_sql(m: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v) if isinstance(v, str) else '[' + ', '.join(map(q, v)) + ']'}" for k, v in m.items()) + "}"


def expand_sql(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z0-9_]+'), lambda t: coalesce({map_sql(V.ABBREVIATIONS)}[lower(t)], t)), ' ')"


def tokens_sql(c: str) -> str:
    stop = "[" + ", ".join(map(q, V.STOP_WORDS)) + "]"
    return f"list_filter(regexp_extract_all(lower({expand_sql(c)}), '[a-z0-9]+'), lambda t: NOT list_contains({stop}, t) AND (length(t) > 1 OR regexp_full_match(t, '[0-9bcdkt]')))"


def _bm25(queries: str) -> str:
    clean = "upper(regexp_replace(code, '[^A-Za-z0-9]', '', 'g'))"
    return f"""
docs AS (SELECT row_id, {tokens_sql(f"concat_ws(' ', {clean}, description, synonyms)")} AS tokens FROM sample_hospital_icd WHERE description IS NOT NULL),
size AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
post AS (SELECT row_id, term, dl, count(*) AS tf FROM (SELECT row_id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, size GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS ({queries}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM asked) GROUP BY ALL),
hits AS (SELECT query_id, row_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM qt JOIN post USING (term) JOIN idf USING (term), size GROUP BY ALL)"""


def sql() -> dict[str, str]:
    queries = f"SELECT row_id AS query_id, {tokens_sql('description')} AS tokens FROM hospital_icd_uploads WHERE row_id % 50 = 0 AND description IS NOT NULL"
    ranked = lambda src, k: f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM {src} WHERE score > 0 QUALIFY rank <= {k})"
    _RELATED = map_sql(V.RELATED)
    cover = lambda k, src="hits", a="asked": f"SELECT h.query_id, h.row_id, round(0.5 * h.score / max(h.score) OVER (PARTITION BY h.query_id) + 0.5 * len(list_filter(a.tokens, lambda t: list_has_any(d.tokens, [t] || coalesce({_RELATED}[t], []) || CASE WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 4 THEN [substr(t, 1, length(t) - 1)] ELSE [] END))) / len(a.tokens), 4) AS lexical FROM {ranked(src, k)} h JOIN {a} a USING (query_id) JOIN docs d USING (row_id)"
    words = r"list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda w: w <> '')"
    feats = lambda src: f"""SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS weight FROM (SELECT id, h % 384 AS idx, sum(CASE WHEN h % 2 = 0 THEN v ELSE -v END) AS v FROM (
SELECT id, v, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) AS h FROM (SELECT id, 'w_' || unnest(w) AS f, 1.5 AS v FROM ({src}) UNION ALL
SELECT id, 'c_' || substr(x, CAST(i AS BIGINT), 3), 0.5 FROM (SELECT id, x, unnest(range(1, greatest(1, length(x) - 2) + 1)) AS i FROM (SELECT id, unnest(w) AS x FROM ({src}))))) GROUP BY ALL)"""  # noqa: E731
    cat = f"SELECT row_id AS id, {words.format(t='description')} AS w FROM sample_hospital_icd WHERE description IS NOT NULL"
    ask = f"SELECT row_id AS id, {words.format(t=expand_sql('description'))} AS w FROM hospital_icd_uploads WHERE row_id % 50 = 0 AND description IS NOT NULL"
    jac = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
    a, b = jac.format(c="raw_term"), jac.format(c="normalized_diagnosis")
    return {
        "bm25_idf": f"WITH {_bm25(queries)} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "bm25_topk": f"WITH {_bm25(queries)} SELECT query_id, row_id, score, rank FROM {ranked('hits', 10)}",
        "bm25_coverage": f"WITH {_bm25(queries)} {cover(350)}",
        "hash_embed": f"SELECT id AS row_id, idx, round(weight, 5) AS weight FROM ({feats(cat)}) WHERE NOT isnan(weight)",
        "vector_topk": """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0)
SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s QUALIFY rank <= 10""",
        "lexical_by_chapter": f"""
WITH {_bm25(queries)}, lex AS ({cover(350)}), s AS (SELECT query_id, substr(code, 1, 1) AS chapter, row_id, lexical AS score FROM lex JOIN sample_hospital_icd USING (row_id))
SELECT query_id, chapter, row_id, score, row_number() OVER (PARTITION BY query_id, chapter ORDER BY score DESC, row_id) AS rank FROM s QUALIFY rank <= 2""",
        "concept_jaccard": f"SELECT DISTINCT raw_term, normalized_diagnosis, round(CASE WHEN len(list_distinct({a} || {b})) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) ELSE 0 END, 4) AS jaccard FROM diagnosis_candidates WHERE raw_term IS NOT NULL AND normalized_diagnosis IS NOT NULL",
    }
