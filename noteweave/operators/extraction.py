"""Diagnostic mentions of notes, phase by phase: from lists, complaints, history, course, investigations, procedures, narrative.

A note is taken apart once, within its row, into lines with their section; a line into clauses. The section decides the
phase, a table of phases says how a term stands in its clauses (the whole of it in lists, after a cue elsewhere), with
which role and score. Polarity, certainty, acuity and side are those of the term's own clause. Mentions of one term in one
note are folded into one: the surest statement, the first place, the best role, all quotes.

Scale: no shuffle before the fold; the fold combines before its shuffle on (note, term). A hot note is many terms, so its
rows spread.

Cases: null and blank texts mention nothing; a term that no kind of entity fits, or that the gate rejects, is none;
repeated clauses count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.operators import mentions, notes, terms

#: Phases in order: name, sections, cue that a term follows (none: the whole clause), role, score.
PHASES = [
    ("diagnosis_list", ["DISCHARGE_DIAGNOSES", "PRINCIPAL_DIAGNOSIS", "SECONDARY_DIAGNOSES", "DISCHARGE_SUMMARY", "ASSESSMENT"], "", "SECONDARY", 10.0),
    ("complaint", ["CHIEF_COMPLAINT"], "", "SECONDARY", 2.0),
    ("history", ["PAST_MEDICAL_HISTORY", "PAST_SURGICAL_HISTORY"], "", "HISTORICAL", -10.0),
    ("course", ["HOSPITAL_COURSE", "COMPLICATIONS"], "developed|complicated by|found to have|diagnosed with|treated for|admitted with|presented with|evidence of|because of|suffered", "SECONDARY", 4.0),
    ("investigation", ["INVESTIGATIONS", "MICROBIOLOGY", "ONCOLOGY_BIOMARKERS"], "showed|shows|revealed|consistent with|suggestive of|suggests|grew|positive for|evidence of|negative for", "SECONDARY", 3.5),
    ("procedure", ["PROCEDURES"], "for|due to|because of|indicated by", "SECONDARY", 4.5),
    ("finding", ["OPERATIVE_FINDINGS", "PHYSICAL_EXAMINATION"], "showed|revealed|found|noted", "SECONDARY", 3.0),
    ("narrative", [], "admitted with|presented with|presents with|diagnosed with|history of|treated for|complains of|evidence of|positive for|suspected|known", "SECONDARY", 1.0),
]
#: Words at which a term after a cue ends, and what says that a past illness is still treated.
TERM_ENDS = "on|in|and|was|were|is|by|after|for|because|which|that|during|at|but|since|about|from"
TREATED = ["on treatment", "on medication", "currently on", "takes", "taking", "continues on", "controlled with"]
#: Sections of orders and advice are no place of diagnoses.
SKIPPED = ["ALLERGIES", "MEDICATIONS", "PLAN", "DISCHARGE_INSTRUCTIONS", "PERTINENT_NEGATIVES"]


def cue_regex(cues: str) -> str:
    """The first group is the term after a cue, up to a word or mark that ends it."""
    return rf"(?i)\b(?:{cues})\s+(?:a |an |the )?([A-Za-z][A-Za-z0-9' -]*?)(?:\s+(?:{TERM_ENDS})\b|[.,;:()?!]|$)"


def phase_of(section: Column) -> Column:
    out = F.lit(len(PHASES) - 1)
    for k, (_, sections, *_rest) in reversed(list(enumerate(PHASES))):
        if sections:
            out = F.when(section.isin(*sections), k).otherwise(out)
    return out


def raw_mentions(docs: DataFrame) -> DataFrame:
    """(id, line_no, clause_no, section, phase, clause, term, polarity, acuity, side, role, score) before the fold."""
    lines = notes.lines_of(docs).where(~F.col("section").isin(*SKIPPED))
    parts = mentions.clauses(lines).withColumn("phase_no", phase_of(F.col("section"))).withColumn("clause", T.trim(F.col("clause"))).where("clause <> ''")
    whole = F.regexp_replace(F.regexp_replace("clause", r"^(?:[-*•]|\d+[.)])\s*", ""), r"[.,;:?!]+$", "")
    term, name, role, score = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for k, (phase, _, cues, r, points) in enumerate(PHASES):
        here = F.col("phase_no") == k
        term = F.when(here, F.nullif(F.regexp_extract("clause", cue_regex(cues), 1), F.lit("")) if cues else whole).otherwise(term)
        name, role, score = F.when(here, phase).otherwise(name), F.when(here, r).otherwise(role), F.when(here, points).otherwise(score)
    found = parts.withColumn("term", T.trim(F.lower(term))).where("term is not null and term <> '' and opens is null")
    found = found.where(~terms.entity_kind(F.col("term")).isin("NONE", "OTHER") & terms.reject_reason(F.col("term")).isNull())
    acuity, polarity = T.acuity(F.col("clause")), T.polarity(F.col("clause"))
    symptom = terms.entity_kind(F.col("term")) == "SYMPTOM"
    treated = (name == "history") & T.has_cue(F.col("clause"), TREATED)
    points = (
        F.when(treated, 3.0).when((name == "complaint") & ~symptom, 3.5).when((name == "investigation") & F.col("clause").contains("?"), -5.0).otherwise(score)
        + F.when((name.isin("course", "procedure")) & acuity.isin("ACUTE", "ACUTE_ON_CHRONIC"), 1.0).otherwise(0.0)
    )
    return found.select(
        "id", "line_no", "clause_no", "section", name.alias("phase"), "phase_no", "clause", "term", polarity.alias("polarity"), acuity.alias("acuity"), T.laterality(F.col("clause")).alias("side"),
        F.when(treated, "SECONDARY").otherwise(role).alias("role"), F.when(polarity == "NEGATED", -50.0).otherwise(points).alias("score"),
    )


def mentions_of(docs: DataFrame) -> DataFrame:
    """One row per note and term: id, term, phase, section, polarity, acuity, side, role, score, line_no, n_mentions, n_phases.

    An affirmed statement wins over an uncertain one, that over a negated one; then the best score, then the first place.
    """
    m = raw_mentions(docs)
    sure = F.when(F.col("polarity") == "AFFIRMED", 0).when(F.col("polarity") == "UNCERTAIN", 1).otherwise(2)
    best = F.min_by(F.struct("phase", "section", "polarity", "acuity", "side", "role", "score", "line_no"), F.struct(sure, -F.col("score"), F.col("phase_no"), F.col("line_no"), F.col("clause_no")))
    return m.groupBy("id", "term").agg(best.alias("b"), F.count("*").alias("n_mentions"), F.countDistinct("phase").alias("n_phases")).select("id", "term", "b.*", "n_mentions", "n_phases")


def with_primary(folded: DataFrame) -> DataFrame:
    """The mentions with `final_role`: the best affirmed current one of a note is PRIMARY (of equals the first), negated ones are RULED_OUT."""
    ok = (F.col("polarity") == "AFFIRMED") & (F.col("role") != "HISTORICAL")
    first = folded.where(ok).groupBy("id").agg(F.min_by("term", F.struct(-F.col("score"), F.col("line_no"), F.col("term"))).alias("first"))
    role = F.when(F.col("polarity") == "NEGATED", "RULED_OUT").when(F.col("polarity") == "UNCERTAIN", "UNCERTAIN").when(F.col("term") == F.col("first"), "PRIMARY").otherwise(F.col("role"))
    return folded.join(first, "id", "left").withColumn("final_role", role).drop("first")
