"""Queries of ordered rules, of term splitting and of the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.operators import catalogue, rules, splitters
from noteweave.operators import notes as N
from noteweave.plans.note_queries import MENTIONS, cue_sql
from noteweave.plans.retrieval_queries import q
from noteweave.session import table


def _merged(spark, d):
    return catalogue.merge_duplicates(catalogue.standard_rows(table(spark, d, "sample_hospital_icd")))


def code_validation(spark, d):
    """The outcome of the code checks for every uploaded row, against the catalogue."""
    up = table(spark, d, "hospital_icd_uploads").select(F.col("row_id").alias("key"), "code", F.lit(None).cast("double").alias("score"), F.col("description").alias("term"))
    return rules.validate_codes(up, _merged(spark, d))


def encounter_checks(spark, d):
    """Violations of the notes whose terms are entries as written."""
    s = table(spark, d, "sample_hospital_icd").where("description is not null").groupBy(F.lower("description").alias("term")).agg(F.min(T.unformat_code(F.col("code"))).alias("clean"))
    m = N.latest_mentions(table(spark, d, "diagnosis_candidates")).select(F.col("document_id").alias("group_id"), F.lower("raw_term").alias("term"), "role")
    return rules.validate_encounter(m.join(s, "term").select("group_id", "clean", "role"), catalogue.exclusion_edges(table(spark, d, "sample_hospital_icd")))


def split_terms(spark, d):
    """Every distinct written term with its head, attributes and conditions."""
    t = table(spark, d, "diagnosis_candidates").select(F.col("raw_term").alias("term")).where("term is not null").distinct()
    x = t.withColumn("head", splitters.head_of(F.col("term"))).withColumn("a", splitters.attributes_of(F.col("term")))
    return x.select(F.md5("term").alias("key"), "head", "a.grade", "a.stage", splitters.without_attributes(F.col("head")).alias("plain"), F.array_join(splitters.compounds("head"), " | ").alias("conditions"))


QUERIES = {f.__name__: f for f in (code_validation, encounter_checks, split_terms)}


def sql() -> dict[str, str]:
    trim = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    clean = lambda c: f"upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"
    flag = f"lower({trim.format(c='is_valid_billable')})"
    side = lambda c: f"CASE WHEN {cue_sql(c, ['bilateral', 'both'])} THEN 'BILATERAL' WHEN {cue_sql(c, ['right', 'rt'])} THEN 'RIGHT' WHEN {cue_sql(c, ['left', 'lt'])} THEN 'LEFT' ELSE 'NONE' END"
    named = r"unnest(regexp_extract_all(exclusion_terms, '([A-Z][0-9][0-9](?:\.[0-9A-Z]+)?)', 1))"
    edges = rf"""e0 AS (SELECT {clean("code")} AS a, {clean(named)} AS b FROM sample_hospital_icd WHERE exclusion_terms IS NOT NULL),
e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e0 WHERE a <> b)"""
    return {
        "code_validation": f"""
WITH s AS (SELECT {clean("code")} AS clean, row_id, {trim.format(c="description")} AS description, CASE WHEN {flag} IN ('1', 'true', 'yes', 'y', 't', 'billable') THEN true WHEN {flag} IN ('0', 'false', 'no', 'n', 'f', 'header', 'non-billable') THEN false END AS billable FROM sample_hospital_icd),
c AS (SELECT clean, unnest(arg_min({{'description': description, 'billable': billable}}, row_id)) FROM s WHERE length(clean) BETWEEN 3 AND 7 AND regexp_matches(clean, '^[A-Z][0-9][0-9A-Z]{{1,5}}$') AND description <> '' GROUP BY clean),
j AS (SELECT u.row_id AS key, {clean("u.code")} AS uc, c.description AS cd, c.billable, u.description AS ud FROM hospital_icd_uploads u LEFT JOIN c ON c.clean = {clean("u.code")}),
k AS (SELECT *, {side("cd")} AS w, {side("ud")} AS h FROM j)
SELECT key, CASE WHEN coalesce(uc, '') = '' THEN {q(rules.NO_CANDIDATE)} WHEN cd IS NULL THEN {q(rules.INVALID)} WHEN NOT coalesce(billable, false) THEN {q(rules.HEADER)}
WHEN w <> 'NONE' AND h <> 'NONE' AND w <> h THEN {q(rules.SIDE)} ELSE {q(rules.VALID)} END AS outcome FROM k""",
        "encounter_checks": f"""
WITH {MENTIONS}, s AS (SELECT lower(description) AS term, min({clean("code")}) AS clean FROM sample_hospital_icd WHERE description IS NOT NULL GROUP BY 1), {edges},
g AS (SELECT document_id AS group_id, clean, role FROM m JOIN s ON s.term = lower(m.raw_term)),
p AS (SELECT group_id, count(DISTINCT CASE WHEN role = 'PRIMARY' THEN clean END) AS p FROM g GROUP BY 1), u AS (SELECT DISTINCT group_id, clean FROM g)
SELECT group_id, 'MULTIPLE_PRIMARY' AS "check", p AS n FROM p WHERE p > 1 UNION ALL SELECT group_id, 'NO_PRIMARY', 1 FROM p WHERE p = 0
UNION ALL SELECT x.group_id, 'EXCLUDED_PAIR', count(*) FROM e JOIN u x ON x.clean = e.a JOIN u y ON y.clean = e.b AND y.group_id = x.group_id GROUP BY 1""",
    }
