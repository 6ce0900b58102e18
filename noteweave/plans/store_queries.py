"""Queries of the encounter store and the run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave.operators import store as S
from noteweave.operators.notes import latest_mentions
from noteweave.plans.note_queries import MENTIONS
from noteweave.session import table


def _d(spark, d):
    return table(spark, d, "clinical_documents")


def _m(spark, d):
    return latest_mentions(table(spark, d, "diagnosis_candidates"))


def _e(spark, d):
    return table(spark, d, "events")


def store_search(spark, d):
    return S.search(_d(spark, d), "oedema", "ALL", _m(spark, d).where("role = 'PRIMARY'")).select("id", "document_id")


def store_page(spark, d):
    return S.page(_d(spark, d).select("id", "document_id", "created_at"), 100, 200).select("id", "document_id")


def store_upsert(spark, d):
    docs = _d(spark, d).select("document_id", "id", "received_at", "status")
    last = S.latest(docs, "document_id", ["received_at", "id"])
    new = last.where("id % 7 = 0").withColumn("status", F.lit("RECODED"))  # the new versions of this made-up batch
    return S.upsert(last, new, "document_id").groupBy(F.coalesce("status", F.lit("NONE")).alias("status")).agg(F.count("*").alias("n"))


def store_delete_cascade(spark, d):
    gone = _d(spark, d).where("status is null")
    left = S.delete_cascade(gone, "document_id", documents=_d(spark, d).select("document_id"), mentions=_m(spark, d).select("document_id"), snippets=table(spark, d, "evidence_snippets").select("document_id"))
    out = None
    for name, t in left.items():
        n = t.agg(F.count("*").alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
        out = n if out is None else out.unionByName(n)
    return out


def export_frame(spark, d):
    x = _d(spark, d)
    return x.select("id", F.coalesce("document_id", F.lit("N/A")).alias("document_id"), F.coalesce("filename", F.lit("N/A")).alias("filename"), F.coalesce("status", F.lit("N/A")).alias("status"), F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))


def analytics_totals(spark, d):
    return S.totals(_d(spark, d), _m(spark, d))


def analytics_by_status(spark, d):
    return _d(spark, d).groupBy(F.coalesce("status", F.lit("NONE")).alias("status")).agg(F.count("*").alias("n"))


def analytics_top_primary(spark, d):
    return S.top_terms(_m(spark, d), "PRIMARY")


def analytics_top_secondary(spark, d):
    return S.top_terms(_m(spark, d), "SECONDARY")


def analytics_abstention_dist(spark, d):
    return _m(spark, d).where("not coalesce(is_authorized, true)").groupBy(F.coalesce("assertion_status", F.lit("NONE")).alias("assertion_status"), F.coalesce("certainty", F.lit("NONE")).alias("certainty")).agg(F.count("*").alias("n"))


def analytics_rollup(spark, d):
    return S.status_rollup(_d(spark, d))


def code_consolidate(spark, d):
    return S.consolidate(_m(spark, d))


def subsume_category_codes(spark, d):
    u = table(spark, d, "hospital_icd_uploads").where("code is not null")
    code = F.upper(F.regexp_replace("code", "[^A-Za-z0-9]", ""))
    coded = u.select(F.col("site_id").alias("group_id"), code.alias("code")).distinct()
    c = table(spark, d, "sample_hospital_icd").select(F.upper(F.regexp_replace("code", "[^A-Za-z0-9]", "")).alias("strong")).distinct()
    return S.subsume(coded, c.where("length(strong) > 3").select("strong", F.substring("strong", 1, 3).alias("weak")))


def drop_coded_abstentions(spark, d):
    return S.open_abstentions(_m(spark, d))


def document_status(spark, d):
    return S.document_status(_d(spark, d), _m(spark, d))


def audit_trail(spark, d):
    return S.audit(_d(spark, d), _m(spark, d), table(spark, d, "evidence_snippets"))


def thread_latest(spark, d):
    return S.thread_latest(_e(spark, d)).select("user_id", "last_step", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "n_steps")


def event_type_progress(spark, d):
    return S.step_progress(_e(spark, d))


def latency_breakdown(spark, d):
    return S.latency_breakdown(_e(spark, d))


def batch_status(spark, d):
    return S.batch_status(_d(spark, d))


def term_agreement(spark, d):
    """Of mentions with both terms, how many agree word for word, and how many agree in case-free text."""
    m = table(spark, d, "diagnosis_candidates").where("raw_term is not null and normalized_diagnosis is not null")
    same = F.lower(F.trim("raw_term")) == F.lower(F.trim("normalized_diagnosis"))
    pct = lambda c: F.round(F.when(F.count("*") > 0, 100.0 * F.count_if(c) / F.count("*")).otherwise(100.0), 2)
    return m.groupBy("entity_type").agg(F.count("*").alias("n"), pct(F.col("raw_term") == F.col("normalized_diagnosis")).alias("exact_percent"), pct(same).alias("caseless_percent"))


def run_rate_tumbling(spark, d):
    return S.run_rate(_e(spark, d))


def run_sessions(spark, d):
    return S.run_sessions(_e(spark, d))


QUERIES = {f.__name__: f for f in (store_search, store_page, store_upsert, store_delete_cascade, export_frame, analytics_totals, analytics_by_status, analytics_top_primary, analytics_top_secondary, analytics_abstention_dist, analytics_rollup, code_consolidate, subsume_category_codes, drop_coded_abstentions, document_status, audit_trail, thread_latest, event_type_progress, latency_breakdown, batch_status, term_agreement, run_rate_tumbling, run_sessions)}


def sql() -> dict[str, str]:
    top = lambda role: f"WITH {MENTIONS} SELECT lower(trim(raw_term, ' ')) AS term, count(*) AS n FROM m WHERE role = '{role}' AND trim(raw_term, ' ') <> '' GROUP BY 1 ORDER BY n DESC, term LIMIT 10"
    clean = "upper(regexp_replace(code, '[^A-Za-z0-9]', '', 'g'))"
    gone = "document_id NOT IN (SELECT document_id FROM clinical_documents WHERE status IS NULL AND document_id IS NOT NULL)"
    return {
        "store_search": f"WITH {MENTIONS} SELECT id, document_id FROM clinical_documents WHERE (document_id ILIKE '%oedema%' OR filename ILIKE '%oedema%' OR status ILIKE '%oedema%' OR text ILIKE '%oedema%') AND document_id IN (SELECT document_id FROM m WHERE role = 'PRIMARY')",
        "store_page": "SELECT id, document_id FROM clinical_documents ORDER BY created_at DESC NULLS LAST, id LIMIT 100 OFFSET 200",
        "store_upsert": """
WITH l AS (SELECT document_id, max_by(id, (received_at, id)) AS id, max_by({'s': status}, (received_at, id)).s AS status FROM clinical_documents GROUP BY 1)
SELECT coalesce(CASE WHEN id % 7 = 0 THEN 'RECODED' ELSE status END, 'NONE') AS status, count(*) AS n FROM l GROUP BY 1""",
        "store_delete_cascade": f"""
WITH {MENTIONS} SELECT 'documents' AS table_name, count(*) AS n_left FROM clinical_documents WHERE {gone} UNION ALL SELECT 'mentions', count(*) FROM m WHERE {gone} UNION ALL SELECT 'snippets', count(*) FROM evidence_snippets WHERE {gone}""",
        "export_frame": "SELECT id, coalesce(document_id, 'N/A') AS document_id, coalesce(filename, 'N/A') AS filename, coalesce(status, 'N/A') AS status, coalesce(page_count, 0) AS page_count, coalesce(length(text), 0) AS n_chars FROM clinical_documents",
        "analytics_totals": f"""
WITH {MENTIONS} SELECT (SELECT count(*) FROM clinical_documents) AS n_documents, (SELECT round(coalesce(avg(word_count), 0), 2) FROM clinical_documents) AS avg_words, count(*) AS n_mentions,
count(*) FILTER (role = 'PRIMARY') AS n_primary, count(*) FILTER (NOT coalesce(is_authorized, true)) AS n_refused, round(100.0 * count(*) FILTER (is_authorized) / greatest(count(*), 1), 1) AS authorized_percent FROM m""",
        "analytics_by_status": "SELECT coalesce(status, 'NONE') AS status, count(*) AS n FROM clinical_documents GROUP BY 1",
        "analytics_top_primary": top("PRIMARY"),
        "analytics_top_secondary": top("SECONDARY"),
        "analytics_abstention_dist": f"WITH {MENTIONS} SELECT coalesce(assertion_status, 'NONE') AS assertion_status, coalesce(certainty, 'NONE') AS certainty, count(*) AS n FROM m WHERE NOT coalesce(is_authorized, true) GROUP BY 1, 2",
        "analytics_rollup": "SELECT coalesce(a, 'ALL') AS status, coalesce(b, 'ALL') AS source_type, count(*) AS n FROM (SELECT coalesce(status, 'NONE') AS a, coalesce(source_type, 'NONE') AS b FROM clinical_documents) GROUP BY ROLLUP (a, b)",
        "code_consolidate": f"WITH {MENTIONS} SELECT document_id, lower(trim(raw_term, ' ')) AS term, max(CASE WHEN role = 'PRIMARY' THEN 1 ELSE 0 END) AS is_primary, max(coalesce(candidate_confidence, 0.0)) AS confidence, count(*) AS n_merged FROM m WHERE trim(raw_term, ' ') <> '' GROUP BY 1, 2",
        "subsume_category_codes": f"""
WITH c AS (SELECT DISTINCT site_id AS group_id, {clean} AS code FROM hospital_icd_uploads WHERE code IS NOT NULL), s AS (SELECT DISTINCT {clean} AS strong FROM sample_hospital_icd)
SELECT group_id, code FROM c WHERE NOT EXISTS (SELECT 1 FROM c x JOIN s ON s.strong = x.code WHERE x.group_id = c.group_id AND length(s.strong) > 3 AND substr(s.strong, 1, 3) = c.code)""",
        "drop_coded_abstentions": f"""
WITH {MENTIONS}, k AS (SELECT document_id, lower(trim(raw_term, ' ')) AS term, coalesce(is_authorized, true) AS ok FROM m WHERE trim(raw_term, ' ') <> '')
SELECT DISTINCT document_id, term FROM k WHERE NOT ok EXCEPT SELECT document_id, term FROM k WHERE ok""",
        "document_status": f"""
WITH {MENTIONS}, n AS (SELECT document_id, count(*) FILTER (coalesce(is_authorized, true)) AS ok, count(*) AS n FROM m GROUP BY 1)
SELECT document_id, CASE WHEN coalesce(ok, 0) = 0 THEN 'ABSTAINED' WHEN ok < n THEN 'PARTIAL' ELSE 'SUCCESS' END AS outcome FROM (SELECT DISTINCT document_id FROM clinical_documents) LEFT JOIN n USING (document_id)""",
        "audit_trail": f"""
WITH {MENTIONS}, d AS (SELECT document_id, max_by({{'s': status}}, (received_at, id)).s AS status FROM clinical_documents GROUP BY 1), s AS (SELECT diagnosis_id, count(DISTINCT snippet_id) AS n FROM evidence_snippets WHERE diagnosis_id IS NOT NULL GROUP BY 1)
SELECT m.diagnosis_id, m.document_id, coalesce(d.status, 'NONE') AS status, coalesce(s.n, 0) AS n_snippets FROM m LEFT JOIN d USING (document_id) LEFT JOIN s USING (diagnosis_id)""",
        "thread_latest": "SELECT user_id, max_by(event_type, (ts, event_id)) AS last_step, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n_steps FROM events GROUP BY 1",
        "event_type_progress": "SELECT user_id, round(least(100.0, 100.0 * count(DISTINCT event_type) / 10), 1) AS percent FROM events GROUP BY 1",
        "latency_breakdown": "SELECT event_type, count(*) AS n, round(avg(ms), 2) AS avg_ms, max(ms) AS max_ms FROM (SELECT event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000 AS ms FROM events) WHERE ms IS NOT NULL GROUP BY 1",
        "batch_status": "SELECT site_id, count(*) AS n, count(*) FILTER (trim(text, ' ') <> '') AS n_ready, count(*) FILTER (coalesce(trim(text, ' '), '') = '') AS n_empty, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM clinical_documents GROUP BY 1",
        "term_agreement": "SELECT entity_type, count(*) AS n, round(100.0 * count(*) FILTER (raw_term = normalized_diagnosis) / count(*), 2) AS exact_percent, round(100.0 * count(*) FILTER (lower(trim(raw_term, ' ')) = lower(trim(normalized_diagnosis, ' '))) / count(*), 2) AS caseless_percent FROM diagnosis_candidates WHERE raw_term IS NOT NULL AND normalized_diagnosis IS NOT NULL GROUP BY 1",
        "run_rate_tumbling": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
        "run_sessions": """
WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a), c AS (SELECT user_id, s, count(*) AS n FROM b GROUP BY 1, 2)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
    }
