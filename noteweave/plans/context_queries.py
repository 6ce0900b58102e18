"""Queries over the context of mentions and over results."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave import pipeline
from noteweave.operators import context as X
from noteweave.operators import notes as N
from noteweave.plans.note_queries import MENTIONS, score_sql
from noteweave.session import table


def _mentions(spark, d):
    return N.latest_mentions(table(spark, d, "diagnosis_candidates"))


def context_assessment(spark, d):
    return X.assess(_mentions(spark, d)).groupBy("context", "eligible").agg(F.count("*").alias("n"))


def result_checks(spark, d):
    m, cat = _mentions(spark, d), table(spark, d, "sample_hospital_icd")
    return X.checks(N.rank_roles(m), pipeline.code_mentions(m, cat, table(spark, d, "clinical_documents"), table(spark, d, "evidence_snippets")), cat)


def result_text(spark, d):
    m = _mentions(spark, d)
    return X.render(N.rank_roles(m), m).select("document_id", F.md5("report").alias("digest"))


QUERIES = {f.__name__: f for f in (context_assessment, result_checks, result_text)}


def sql() -> dict[str, str]:
    ctx = """CASE WHEN upper(certainty) IN ('AMBIGUOUS', 'UNCERTAIN') THEN 'AMBIGUOUS' WHEN upper(assertion_status) IN ('NEGATED', 'ABSENT', 'RULED_OUT') OR upper(certainty) = 'RULED_OUT' THEN 'RULED_OUT'
WHEN upper(temporality) IN ('HISTORICAL', 'HISTORY', 'PAST') THEN 'HISTORICAL' WHEN upper(temporality) = 'RESOLVED' THEN 'RESOLVED' ELSE 'ACTIVE' END"""
    return {
        "context_assessment": f"WITH {MENTIONS}, c AS (SELECT {ctx} AS context, is_authorized FROM m) SELECT context, context IN ('ACTIVE', 'AMBIGUOUS') AND coalesce(is_authorized, true) AS eligible, count(*) AS n FROM c GROUP BY 1, 2",
        "result_text": f"""
WITH {MENTIONS}, k AS (SELECT *, {score_sql()} AS sc FROM m WHERE coalesce(assertion_status <> 'NEGATED', true) AND coalesce(is_authorized, true)),
r AS (SELECT document_id, raw_term, round(sc, 3) AS score, row_number() OVER (PARTITION BY document_id ORDER BY sc DESC, diagnosis_id) AS position FROM k)
SELECT document_id, md5(string_agg(printf('%d. [%s] %s (%.3f)', position, CASE position WHEN 1 THEN 'PRIMARY' ELSE 'SECONDARY' END, coalesce(raw_term, '-'), score), chr(10) ORDER BY position)) AS digest FROM r GROUP BY 1""",
    }
