"""Queries of the problems tagged llm, and their SQL twins where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave.llm import canonical, encoding, mixture, personal, pieces, scans, sentences, tokens
from noteweave.session import spread, table


def p1_found(spark, d):
    docs = table(spark, d, "clinical_documents")
    return pieces.split_documents(docs).where("piece_no = 2").select("id").distinct()


def p1_pieces(spark, d):
    return pieces.split_documents(table(spark, d, "clinical_documents"))


def p2_found(spark, d):
    return canonical.map_candidates(table(spark, d, "diagnosis_candidates"), table(spark, d, "sample_hospital_icd"))


def p2_report(spark, d):
    rows = table(spark, d, "diagnosis_candidates").select("diagnosis_id", "entity_type").dropDuplicates(["diagnosis_id"])
    return rows.join(p2_found(spark, d), "diagnosis_id").groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("code") == canonical.UNMATCHED).alias("n_unmatched"))


def p3_found(spark, d):
    return encoding.found(spark, table(spark, d, "clinical_documents"))


def p3_restored(spark, d):
    return encoding.restored(spark, table(spark, d, "clinical_documents"))


def p4_found(spark, d):
    return personal.found(spark, table(spark, d, "clinical_documents"), table(spark, d, "evidence_snippets"))


def p4_redacted(spark, d):
    return personal.redact(spark, table(spark, d, "clinical_documents"), table(spark, d, "evidence_snippets"))


def p7_found(spark, d):
    return scans.found(spark, spread(table(spark, d, "clinical_documents").select("id", "text"), spark))


def p7_repaired(spark, d):
    return scans.repaired(spark, spread(table(spark, d, "clinical_documents").select("id", "text"), spark))


def p8_ids(spark, d):
    return tokens.encode_documents(spark, spread(table(spark, d, "documents").select("doc_id", "text"), spark))


def p9_mixture(spark, d):
    return mixture.mixture(spark, table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_shares(spark, d):
    return mixture.shares(spark, table(spark, d, "documents"), table(spark, d, "source_targets"))


def p10_found(spark, d):
    return sentences.units(spark, spread(table(spark, d, "documents").select("doc_id", "text"), spark)).distinct()


_QUERIES = [p1_found, p1_pieces, p2_found, p2_report, p3_found, p3_restored, p4_found, p4_redacted, p7_found, p7_repaired, p8_ids, p9_mixture, p9_shares, p10_found]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT id FROM clinical_documents WHERE length(text) > 2000",
    }
