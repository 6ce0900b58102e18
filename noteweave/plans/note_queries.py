"""Queries over notes and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave import pipeline
from noteweave.functions import text as T
from noteweave.functions import values as V
from noteweave.operators import extraction as E
from noteweave.operators import matching, terms
from noteweave.operators import mentions as X
from noteweave.operators import notes as N
from noteweave.plans.retrieval_queries import expand_sql, map_sql, q, tokens_sql
from noteweave.session import table


def _docs(spark, d):
    return table(spark, d, "clinical_documents")


def _mentions(spark, d):
    return N.latest_mentions(table(spark, d, "diagnosis_candidates"))


def text_normalize(spark, d):
    n = T.normalize_document(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(n).alias("n_chars_after"), F.md5(n).alias("digest"))


def abbreviation_expand(spark, d):
    e = table(spark, d, "evidence_snippets").where("quote is not null").select("quote").distinct()
    return e.select(F.md5("quote").alias("key"), T.expand_abbreviations(F.col("quote")).alias("expanded")).distinct()


def token_counts(spark, d):
    t = table(spark, d, "documents").where("text is not null").select(F.explode(T.clinical_tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


def morphology_expand(spark, d):
    s = table(spark, d, "sample_hospital_icd").where("description is not null")
    return s.select("row_id", F.array_join(F.array_sort(T.related_tokens(T.clinical_tokens(F.col("description")))), " ").alias("words"))


def section_segment(spark, d):
    return N.sections(_docs(spark, d))


def line_offsets(spark, d):
    return N.lines_of(_docs(spark, d)).groupBy("id").agg(F.count("*").alias("n_lines"), F.max("start_char").alias("last_start"))


def char_to_section(spark, d):
    """The section that a span really lies in, for snippets with a span and a document whose text stands once."""
    docs = _docs(spark, d).where("text is not null")
    once = docs.groupBy("document_id").agg(F.min("id").alias("id"))
    s = table(spark, d, "evidence_snippets").where("start_char is not null")
    pts = s.groupBy("snippet_id").agg(F.min(F.struct("document_id", "start_char")).alias("s")).select(F.col("snippet_id").alias("key"), "s.document_id", F.col("s.start_char").alias("at"))
    return N.section_at(pts.join(once, "document_id").select("key", "id", "at"), N.sections(docs)).select(F.col("key").alias("snippet_id"), "section")


def high_yield_text(spark, d):
    return N.high_yield(_docs(spark, d))


def polarity_certainty_cues(spark, d):
    c = F.col("quote")
    e = table(spark, d, "evidence_snippets").where("quote is not null").select("quote").distinct()
    return e.groupBy(T.polarity(c).alias("polarity"), T.acuity(c).alias("acuity"), T.laterality(c).alias("side")).agg(F.count("*").alias("n_quotes"))


def verbatim_spans(spark, d):
    return N.locate_quotes(table(spark, d, "evidence_snippets"), _docs(spark, d)).fillna(-1, ["found_at"])


def admitting_scores(spark, d):
    m = _mentions(spark, d)
    return m.select("diagnosis_id", F.round(N.admitting_score(m), 3).alias("score"))


def role_ranking(spark, d):
    return N.rank_roles(_mentions(spark, d))


def single_primary_violation(spark, d):
    return table(spark, d, "diagnosis_candidates").where("role = 'PRIMARY'").groupBy("document_id").agg(F.countDistinct("diagnosis_id").alias("n_primary")).where("n_primary > 1")


def mention_reconcile(spark, d):
    return N.reconcile(_mentions(spark, d))


def evidence_merge(spark, d):
    return N.merge_quotes(table(spark, d, "evidence_snippets"))


def concept_match(spark, d):
    """The concept score of each written term against the descriptions of its normalised form's entry."""
    c = table(spark, d, "diagnosis_candidates").where("normalized_diagnosis is not null and raw_term is not null").select(F.lower(F.trim("normalized_diagnosis")).alias("key"), F.col("raw_term").alias("concept")).distinct()
    s = table(spark, d, "sample_hospital_icd").where("description is not null").select(F.lower("description").alias("key"), "code", "description").distinct()
    pairs = c.join(s, "key").withColumn("evidence", F.lit(""))
    return matching.score_pairs(pairs).select("code", "concept", "score", "exact")


def pipeline_codes(spark, d):
    """The batch pipeline's codes for every distinct written term of a document."""
    return pipeline.code_mentions(_mentions(spark, d), table(spark, d, "sample_hospital_icd"), _docs(spark, d), table(spark, d, "evidence_snippets"))


def mention_extract(spark, d):
    return X.extract(_docs(spark, d), table(spark, d, "sample_hospital_icd")).select("id", "line_no", "code", "polarity").distinct()


def mention_phases(spark, d):
    """The diagnostic mentions of every note, folded by term."""
    return E.mentions_of(_docs(spark, d))


def mention_roles(spark, d):
    return E.with_primary(E.mentions_of(_docs(spark, d))).groupBy("phase", "final_role").agg(F.count("*").alias("n"))


def mention_sections(spark, d):
    """How often each section names an affirmed, negated or uncertain entry, by the longest phrases only."""
    m = X.longest(X.extract(_docs(spark, d), table(spark, d, "sample_hospital_icd")))
    return m.groupBy("section", "polarity").agg(F.count("*").alias("n_mentions"))


QUERIES = {f.__name__: f for f in (mention_extract, mention_phases, mention_roles, mention_sections, concept_match, pipeline_codes, text_normalize, abbreviation_expand, token_counts, morphology_expand, section_segment, line_offsets, char_to_section, high_yield_text, polarity_certainty_cues, verbatim_spans, admitting_scores, role_ranking, single_primary_violation, mention_reconcile, evidence_merge)}


def cue_sql(c: str, cues: list[str]) -> str:
    return f"coalesce(regexp_matches(lower({c}), {q('(^|[^a-z0-9])(' + '|'.join(cues) + ')([^a-z0-9]|$)')}), false)"


def acuity_sql(c: str) -> str:
    a, k = cue_sql(c, V.ACUTE), cue_sql(c, V.CHRONIC)
    return f"CASE WHEN {a} AND {k} THEN 'ACUTE_ON_CHRONIC' WHEN {a} THEN 'ACUTE' WHEN {k} THEN 'CHRONIC' ELSE 'UNSPECIFIED' END"


MENTIONS = "m AS (SELECT diagnosis_id, unnest(max_by({'document_id': document_id, 'raw_term': raw_term, 'role': role, 'entity_type': entity_type, 'assertion_status': assertion_status, 'certainty': certainty, 'temporality': temporality, 'candidate_confidence': candidate_confidence, 'is_authorized': is_authorized, 'created_at': created_at}, (received_at, coalesce(raw_term, ''), coalesce(role, ''), coalesce(candidate_confidence, -1)))) FROM diagnosis_candidates GROUP BY diagnosis_id)"


def score_sql() -> str:
    return f"""(CASE role WHEN 'PRIMARY' THEN 10.0 WHEN 'SECONDARY' THEN -5.0 ELSE 0.0 END + CASE WHEN temporality = 'HISTORICAL' THEN -10.0 ELSE 0.0 END + CASE WHEN certainty = 'CONFIRMED' THEN 1.0 WHEN certainty IN ('SUSPECTED', 'PROBABLE', 'POSSIBLE') THEN 0.5 ELSE 0.0 END
+ CASE WHEN {acuity_sql('raw_term')} IN ('ACUTE', 'ACUTE_ON_CHRONIC') THEN 2.0 ELSE 0.0 END + CASE WHEN entity_type IN ('SYMPTOM', 'INFECTION') THEN -2.0 ELSE 0.0 END + floor(coalesce(candidate_confidence, 0.0) * 1000 + 0.5) / 1000)"""


def sections_sql() -> str:
    local = map_sql({h: name for name, hs in V.LOCAL_HEADINGS.items() for h in hs})
    plain = r"regexp_replace(line, '[\r\t]', ' ', 'g')"
    head = f"regexp_replace(trim({plain}, ' '), ' *:$', '')"
    cases = " ".join(f"WHEN regexp_matches({plain}, {q(N.section_regex(p))}) THEN {q(name)}" for name, p in V.SECTION_PATTERNS)
    opens = f"CASE WHEN {local}[{head}] IS NOT NULL THEN {local}[{head}] WHEN regexp_matches({plain}, '(?i)^\\s*date of') THEN NULL {cases} END"
    return f"""
p AS (SELECT id, length(text) AS size, string_split(text, chr(10)) AS ls FROM clinical_documents WHERE text IS NOT NULL),
l0 AS (SELECT id, size, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM p),
l1 AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, {opens} AS opens FROM l0),
l AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no), 'GENERAL') AS section FROM l1),
h AS (SELECT id, size, start_char, section FROM l WHERE opens IS NOT NULL OR line_no = 0),
s AS (SELECT id, CAST(row_number() OVER w AS INTEGER) AS section_no, section, start_char, CAST(coalesce(lead(start_char) OVER w, size) AS BIGINT) AS end_char FROM h WINDOW w AS (PARTITION BY id ORDER BY start_char))"""


#: DuckDB's split drops nothing, as Spark's with a limit of -1.
_CLAUSES = f"c0 AS (SELECT id, line_no, start_char, section, opens, string_split_regex(line, {q(X.CLAUSE)}) AS cs FROM l), c AS (SELECT id, line_no, start_char, section, opens, unnest(cs) AS clause, generate_subscripts(cs, 1) - 1 AS clause_no FROM c0)"


def _polarity_sql(c: str) -> str:
    return f"CASE WHEN {cue_sql(c, V.NEGATION)} THEN 'NEGATED' WHEN {cue_sql(c, V.UNCERTAINTY)} OR contains({c}, '?') THEN 'UNCERTAIN' ELSE 'AFFIRMED' END"


def _kind_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {cue_sql(c, w)} THEN {q(k)}" for k, w in terms.KINDS.items()) + " ELSE 'OTHER' END"


def phases_sql() -> str:
    """The whole of the extraction in SQL: f holds one row per note and term."""
    trim = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    phase = "CASE " + " ".join(f"WHEN section IN ({', '.join(map(q, secs))}) THEN {k}" for k, (_, secs, *_r) in enumerate(E.PHASES) if secs) + f" ELSE {len(E.PHASES) - 1} END"
    whole = r"regexp_replace(regexp_replace(clause, '^(?:[-*•]|\d+[.)])\s*', ''), '[.,;:?!]+$', '')"
    pick = lambda i, f: "CASE phase_no " + " ".join(f"WHEN {k} THEN {f(x[i])}" for k, x in enumerate(E.PHASES)) + " END"
    term = pick(2, lambda cues: f"nullif(regexp_extract(clause, {q(E.cue_regex(cues))}, 1), '')" if cues else whole)
    rejected = " OR ".join(f"term IN ({', '.join(map(q, v))})" for v in terms.REJECTED.values())
    return f"""{_CLAUSES},
d AS (SELECT * REPLACE ({trim.format(c="clause")} AS clause), {phase} AS phase_no FROM c WHERE section NOT IN ({", ".join(map(q, E.SKIPPED))}) AND opens IS NULL),
t AS (SELECT *, {trim.format(c=f"lower({term})")} AS term, {pick(0, q)} AS phase, {pick(3, q)} AS role0, {pick(4, str)} AS score0 FROM d WHERE clause <> ''),
k AS (SELECT *, {_kind_sql("term")} AS kind, {_polarity_sql("clause")} AS polarity, {acuity_sql("clause")} AS acuity, phase = 'history' AND {cue_sql("clause", E.TREATED)} AS treated,
  CASE WHEN {cue_sql("clause", ["bilateral", "both"])} THEN 'BILATERAL' WHEN {cue_sql("clause", ["right", "rt"])} THEN 'RIGHT' WHEN {cue_sql("clause", ["left", "lt"])} THEN 'LEFT' ELSE 'NONE' END AS side
  FROM t WHERE term <> '' AND NOT ({rejected}) AND regexp_matches(term, '[a-z]{{3}}') AND NOT {cue_sql("term", V.NEGATION)}),
r AS (SELECT *, CASE WHEN treated THEN 'SECONDARY' ELSE role0 END AS role, CASE WHEN polarity = 'NEGATED' THEN -50.0 ELSE
  CASE WHEN treated THEN 3.0 WHEN phase = 'complaint' AND kind <> 'SYMPTOM' THEN 3.5 WHEN phase = 'investigation' AND contains(clause, '?') THEN -5.0 ELSE score0 END
  + CASE WHEN phase IN ('course', 'procedure') AND acuity IN ('ACUTE', 'ACUTE_ON_CHRONIC') THEN 1.0 ELSE 0.0 END END AS score FROM k WHERE kind <> 'OTHER'),
f AS (SELECT id, term, unnest(arg_min({{'phase': phase, 'section': section, 'polarity': polarity, 'acuity': acuity, 'side': side, 'role': role, 'score': CAST(score AS DOUBLE), 'line_no': CAST(line_no AS INTEGER)}},
  (CASE polarity WHEN 'AFFIRMED' THEN 0 WHEN 'UNCERTAIN' THEN 1 ELSE 2 END, -score, phase_no, line_no, clause_no))), count(*) AS n_mentions, count(DISTINCT phase) AS n_phases FROM r GROUP BY id, term)"""


def sql() -> dict[str, str]:
    norm = f"translate(text, {q(T.PLAIN_FROM)}, {q(T.PLAIN_TO)})"
    for pat, rep in ((T.DROPPED, ""), (r"([a-zA-Z]{3,})-[ \t]*\n[ \t]*([a-zA-Z]{3,})", r"\1\2"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+$", "")):
        norm = f"regexp_replace({norm}, {q(pat)}, {q(rep)}, 'g')"
    rel = map_sql(V.RELATED_WORDS)
    toks = tokens_sql("description")
    singular = "CASE WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 4 THEN [substr(t, 1, length(t) - 1)] ELSE [] END"
    side = f"CASE WHEN {cue_sql('quote', ['bilateral', 'both'])} THEN 'BILATERAL' WHEN {cue_sql('quote', ['right', 'rt'])} THEN 'RIGHT' WHEN {cue_sql('quote', ['left', 'lt'])} THEN 'LEFT' ELSE 'NONE' END"
    pol = f"CASE WHEN {cue_sql('quote', V.NEGATION)} THEN 'NEGATED' WHEN {cue_sql('quote', V.UNCERTAINTY)} OR contains(quote, '?') THEN 'UNCERTAIN' ELSE 'AFFIRMED' END"
    high = ", ".join(map(q, V.HIGH_YIELD))
    plain = r"' ' || array_to_string(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), ' ') || ' '"
    return {
        "mention_extract": f"""
WITH {sections_sql()}, {_CLAUSES}, e AS (SELECT {plain.format(c="description")} AS phrase, min(code) AS code FROM sample_hospital_icd WHERE description IS NOT NULL GROUP BY 1 HAVING trim(phrase) <> ''),
x AS (SELECT id, line_no, clause, {plain.format(c="clause")} AS plain FROM c)
SELECT DISTINCT id, CAST(line_no AS INTEGER) AS line_no, code, {_polarity_sql("clause")} AS polarity FROM x JOIN e ON contains(plain, phrase)""",
        "mention_phases": f"WITH {sections_sql()}, {phases_sql()} SELECT * FROM f",
        "mention_roles": f"""
WITH {sections_sql()}, {phases_sql()}, a AS (SELECT id, arg_min(term, (-score, line_no, term)) AS top FROM f WHERE polarity = 'AFFIRMED' AND role <> 'HISTORICAL' GROUP BY id)
SELECT phase, CASE WHEN polarity = 'NEGATED' THEN 'RULED_OUT' WHEN polarity = 'UNCERTAIN' THEN 'UNCERTAIN' WHEN term = top THEN 'PRIMARY' ELSE role END AS final_role, count(*) AS n FROM f LEFT JOIN a USING (id) GROUP BY ALL""",
        "text_normalize": f"SELECT doc_id, length(n) AS n_chars_after, md5(n) AS digest FROM (SELECT doc_id, {norm} AS n FROM documents WHERE text IS NOT NULL)",
        "abbreviation_expand": f"SELECT DISTINCT md5(quote) AS key, {expand_sql('quote')} AS expanded FROM evidence_snippets WHERE quote IS NOT NULL",
        "token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token",
        "morphology_expand": f"SELECT row_id, array_to_string(list_sort(list_distinct(tk || flatten(list_transform(tk, lambda t: coalesce({rel}[t], []) || {singular})))), ' ') AS words FROM (SELECT row_id, {toks} AS tk FROM sample_hospital_icd WHERE description IS NOT NULL)",
        "section_segment": f"WITH {sections_sql()} SELECT * FROM s",
        "line_offsets": f"WITH {sections_sql()} SELECT id, count(*) AS n_lines, CAST(max(start_char) AS BIGINT) AS last_start FROM l GROUP BY id",
        "high_yield_text": f"WITH {sections_sql()} SELECT id, count(*) AS n_sections, CAST(sum(end_char - start_char) AS BIGINT) AS n_chars FROM s WHERE section IN ({high}) GROUP BY id",
        "char_to_section": f"""
WITH {sections_sql()}, o AS (SELECT document_id, min(id) AS id FROM clinical_documents WHERE text IS NOT NULL GROUP BY 1),
e AS (SELECT snippet_id, unnest(min({{'document_id': document_id, 'start_char': start_char}})) FROM evidence_snippets WHERE start_char IS NOT NULL GROUP BY 1)
SELECT e.snippet_id, s.section FROM e JOIN o USING (document_id) ASOF JOIN s ON s.id = o.id AND e.start_char >= s.start_char""",
        "polarity_certainty_cues": f"SELECT {pol} AS polarity, {acuity_sql('quote')} AS acuity, {side} AS side, count(*) AS n_quotes FROM (SELECT DISTINCT quote FROM evidence_snippets WHERE quote IS NOT NULL) GROUP BY ALL",
        "admitting_scores": f"WITH {MENTIONS} SELECT diagnosis_id, round({score_sql()}, 3) AS score FROM m",
        "role_ranking": f"""
WITH {MENTIONS}, k AS (SELECT *, {score_sql()} AS sc FROM m WHERE coalesce(assertion_status <> 'NEGATED', true) AND coalesce(is_authorized, true)),
r AS (SELECT document_id, diagnosis_id, round(sc, 3) AS score, row_number() OVER (PARTITION BY document_id ORDER BY sc DESC, diagnosis_id) AS position FROM k)
SELECT *, CASE position WHEN 1 THEN 'PRIMARY' ELSE 'SECONDARY' END AS final_role FROM r""",
        "single_primary_violation": "SELECT document_id, count(DISTINCT diagnosis_id) AS n_primary FROM diagnosis_candidates WHERE role = 'PRIMARY' GROUP BY 1 HAVING count(DISTINCT diagnosis_id) > 1",
        "mention_reconcile": f"""
WITH {MENTIONS}, k AS (SELECT *, lower(trim(raw_term)) AS term, CASE WHEN assertion_status = 'NEGATED' THEN 0 WHEN certainty = 'CONFIRMED' AND temporality = 'CURRENT' THEN 1 ELSE 2 END AS pri FROM m WHERE lower(trim(raw_term)) <> '')
SELECT document_id, term, diagnosis_id, assertion_status, certainty, count(*) OVER (PARTITION BY document_id, term) AS n_mentions FROM k QUALIFY row_number() OVER (PARTITION BY document_id, term ORDER BY pri, -coalesce(candidate_confidence, 0), diagnosis_id) = 1""",
        "evidence_merge": "SELECT diagnosis_id, string_agg(q, ' | ' ORDER BY a, q) AS quotes, count(*) AS n_quotes FROM (SELECT diagnosis_id, trim(quote, ' ') AS q, min(coalesce(start_char, -1)) AS a FROM evidence_snippets WHERE diagnosis_id IS NOT NULL AND trim(quote, ' ') <> '' GROUP BY 1, 2) GROUP BY 1",
        "verbatim_spans": """
WITH o AS (SELECT document_id, arg_min(text, id) AS text FROM clinical_documents WHERE text IS NOT NULL GROUP BY 1),
e AS (SELECT snippet_id, unnest(max_by({'document_id': document_id, 'quote': trim(quote, ' '), 'start_char': start_char}, (received_at, quote))) FROM evidence_snippets WHERE trim(quote, ' ') <> '' GROUP BY 1),
f AS (SELECT snippet_id, start_char, CASE WHEN instr(text, quote) > 0 THEN instr(text, quote) - 1 WHEN instr(lower(text), lower(quote)) > 0 THEN instr(lower(text), lower(quote)) - 1 END AS found_at FROM e JOIN o USING (document_id))
SELECT snippet_id, coalesce(found_at, -1) AS found_at, coalesce(found_at = start_char, false) AS agrees FROM f""",
    }
