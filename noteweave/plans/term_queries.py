"""Queries over terms and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave.functions import values as V
from noteweave.operators import terms as X
from noteweave.plans.note_queries import cue_sql
from noteweave.plans.retrieval_queries import expand_sql, q
from noteweave.session import table


def _terms(spark, d):
    return table(spark, d, "diagnosis_candidates").select(F.col("raw_term").alias("term")).where("term is not null").distinct()


def term_plain_names(spark, d):
    return _terms(spark, d).select(F.md5("term").alias("key"), X.plain_name(F.col("term")).alias("plain"))


def entity_type(spark, d):
    c = table(spark, d, "diagnosis_candidates")
    return c.groupBy(X.entity_kind(F.col("raw_term")).alias("kind")).agg(F.count("*").alias("n"))


def gate_reject_reason(spark, d):
    c = table(spark, d, "diagnosis_candidates")
    return c.groupBy(F.coalesce(X.reject_reason(F.col("raw_term")), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def laterality_check(spark, d):
    c = table(spark, d, "diagnosis_candidates").where("raw_term is not null and normalized_diagnosis is not null")
    return c.groupBy(X.side_demand(F.col("normalized_diagnosis"), F.col("raw_term")).alias("side")).agg(F.count("*").alias("n"))


def sentence_split(spark, d):
    t = table(spark, d, "clinical_documents").where("text is not null")
    return t.select("id", F.size(X.sentences_of(F.col("text"))).alias("n_sentences"))


def evidence_dedup(spark, d):
    s = table(spark, d, "evidence_snippets").where("diagnosis_id is not null and quote is not null")
    lists = s.groupBy("diagnosis_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.coalesce("start_char", F.lit(-1)).alias("at"), F.trim("quote").alias("quote")))), lambda x: x["quote"]).alias("items"))
    return lists.select("diagnosis_id", F.size("items").alias("n_before"), X.without_repetition("items").alias("kept")).select("diagnosis_id", "n_before", F.size("kept").alias("n_after"), F.array_join("kept", " | ").alias("evidence"))


QUERIES = {f.__name__: f for f in (term_plain_names, entity_type, gate_reject_reason, laterality_check, sentence_split, evidence_dedup)}


def sql() -> dict[str, str]:
    trim = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    kind = "CASE WHEN coalesce(" + trim.format(c="raw_term") + ", '') = '' THEN 'NONE' " + " ".join(f"WHEN {cue_sql('raw_term', w)} THEN {q(k)}" for k, w in X.KINDS.items()) + " ELSE 'OTHER' END"
    t = "lower(" + trim.format(c="raw_term") + ")"
    why = f"CASE WHEN coalesce({t}, '') = '' THEN 'empty' " + " ".join(f"WHEN {t} IN ({', '.join(map(q, v))}) THEN {q(k)}" for k, v in X.REJECTED.items()) + f" WHEN NOT regexp_matches({t}, '[a-z]{{3}}') THEN 'no_word' WHEN {cue_sql('raw_term', V.NEGATION)} THEN 'absence' ELSE 'accepted' END"
    side = lambda c: f"CASE WHEN {cue_sql(c, ['bilateral', 'both'])} THEN 'BILATERAL' WHEN {cue_sql(c, ['right', 'rt'])} THEN 'RIGHT' WHEN {cue_sql(c, ['left', 'lt'])} THEN 'LEFT' ELSE 'NONE' END"
    s = trim.format(c="term")
    s = rf"regexp_replace({s}, '^(?:[-*•]|\d+[.)])\s*', '')"
    for _ in range(3):
        s = rf"regexp_replace({s}, '(?i)^(?:h/o|s/p|dx:|known case of|history of|diagnosis:|patient with)\s*', '')"
    for pat, rep in ((r"\((?:[^()]*\d[^()]*|stable|unchanged)\)", " "), (r"\s+[-–—]\s+.*$", ""), (r"[?!.,;:]+$", ""), (r"\s+", " ")):
        s = f"regexp_replace({s}, {q(pat)}, {q(rep)}, 'g')"
    return {
        "term_plain_names": f"SELECT md5(term) AS key, trim(lower({expand_sql(s)})) AS plain FROM (SELECT DISTINCT raw_term AS term FROM diagnosis_candidates WHERE raw_term IS NOT NULL)",
        "entity_type": f"SELECT {kind} AS kind, count(*) AS n FROM diagnosis_candidates GROUP BY 1",
        "gate_reject_reason": f"SELECT {why} AS reason, count(*) AS n FROM diagnosis_candidates GROUP BY 1",
        "laterality_check": f"SELECT CASE WHEN w = 'NONE' THEN 'NONE' WHEN w = h THEN 'SUPPORTED' WHEN h = 'NONE' THEN 'MISSING' ELSE 'CONTRADICTED' END AS side, count(*) AS n FROM (SELECT {side('normalized_diagnosis')} AS w, {side('raw_term')} AS h FROM diagnosis_candidates WHERE raw_term IS NOT NULL AND normalized_diagnosis IS NOT NULL) GROUP BY 1",
    }
