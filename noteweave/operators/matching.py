"""Matching of a documented concept with a candidate entry: concept score, side and polarity checks, best choice.

Scores are sums of column terms; a contradiction (other side) gives 0; ties go to the smaller code. Null evidence counts
as empty; a pair without description or concept scores 0; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.functions import values as V

#: Qualifiers that are no part of a concept's core, and details that an unspecified entry lacks.
PERIPHERAL = [
    "mild", "moderate", "severe", "routine", "unspecified", "uncontrolled", "controlled", "status", "post", "s/p", "primary", "secondary", "admitted", "discharge", "history",
    "compensated", "decompensated", "recurrent", "underlying", "known", "case", "of", "with", "without", "and", "or", "in", "for", "to", "from", "due",
]
DETAILS = ["systolic", "diastolic", "anterior", "inferior", "lateral", "retroperitoneal", "ureteric", "ureter", "antral"]


def concept_words(c: Column) -> Column:
    """Words of a phrase in lower case, without what stands in brackets, abbreviations written out."""
    s = F.regexp_replace(F.lower(c), r"\([^)]*\)|\[[^\]]*\]", " ")
    s = F.regexp_replace(s, r"^\s*\d+[.)-]\s*", "")
    m = T.literal_map(V.ABBREVIATIONS)
    ws = F.transform(T.tokens(s, r"[\p{L}\p{N}]+"), lambda t: F.coalesce(F.try_element_at(m, t), t))
    return F.filter(F.split(F.array_join(ws, " "), " "), lambda t: t != "")


def core_words(words: Column) -> Column:
    long = F.filter(words, lambda t: F.length(t) > 2)
    core = F.filter(long, lambda t: ~t.isin(*PERIPHERAL))
    return F.when(F.size(core) > 0, core).otherwise(long)


def concept_parts(concept: Column) -> Column:
    """What the score needs of a concept alone: its words, how many differ, and the forms of each core word."""
    rel, none = T.literal_map(V.RELATED), F.array().cast("array<string>")
    words = concept_words(concept)
    forms = F.transform(core_words(words), lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(rel, t), none)))
    return F.struct(words.alias("words"), F.size(F.array_distinct(words)).alias("n"), forms.alias("forms"))


def entry_parts(code: Column, description: Column) -> Column:
    """What the score needs of an entry alone."""
    d = concept_words(description)
    has = lambda w: F.array_contains(d, w)
    unspecified = code.rlike(r"\.(9|90|99)$") | has("unspecified")
    return F.struct(d.alias("words"), F.size(F.array_distinct(d)).alias("n"), has("acute").alias("acute"), has("chronic").alias("chronic"), has("left").alias("left"), has("right").alias("right"), unspecified.alias("unspecified"))


def text_cues(text: Column) -> Column:
    """What the score needs of a text about a concept: cues as bits (acute, chronic, left, right, details). A text with
    another one after it has the bits of both."""
    cues = [["acute", "exacerbation", "decompensated"], ["chronic", "longstanding", "compensated"], ["left", "lt"], ["right", "rt"], DETAILS]
    out = F.lit(0)
    for k, words in enumerate(cues):
        out = out + F.when(T.has_cue(text, words), 1 << k).otherwise(0)
    return out


def met_parts(pairs: DataFrame) -> DataFrame:
    """pairs with `__c` (concept_parts) and `__e` (entry_parts), with `__m`: how far their words meet, whatever the evidence."""
    met = F.size(F.filter("__c.forms", lambda f: F.arrays_overlap(f, F.col("__e.words"))))
    x = pairs.withColumn("__met", met).withColumn("__both", F.size(F.array_intersect("__c.words", "__e.words")))
    n, whole = F.size("__c.forms"), F.col("__c.n") + F.col("__e.n") - F.col("__both")
    equal = (F.array_join("__c.words", " ") == F.array_join("__e.words", " ")) & (F.size("__c.words") > 0)
    parts = F.struct(
        F.when(n > 0, F.col("__met") / n).otherwise(0.0).alias("share"), F.when(whole > 0, F.col("__both") / whole).otherwise(0.0).alias("jac"),
        F.when(F.col("__both") == F.col("__c.n"), 0.10).otherwise(0.0).alias("covered"), equal.alias("equal"), (F.col("__c.words").isNull() | (F.size("__c.words") == 0)).alias("wordless"),
    )
    return x.withColumn("__m", parts).drop("__met", "__both")


def with_score(met: DataFrame) -> DataFrame:
    """met (with `__m`, `__e`, and `__bits` of the concept and its evidence) with `score` in 0..1 and `exact`."""
    bit = lambda k: F.col("__bits").bitwiseAND(1 << k) != 0
    a_doc, k_doc, left, right, details = map(bit, range(5))
    a, k, dl, dr = F.col("__e.acute"), F.col("__e.chronic"), F.col("__e.left"), F.col("__e.right")
    share = F.col("__m.share")
    sharp = F.when(a & k, F.when(a_doc & k_doc, 0.10).otherwise(-0.20)).when(a, F.when(a_doc & ~k_doc, 0.10).when(k_doc & ~a_doc, -0.20).otherwise(0.0)).when(k, F.when(k_doc & ~a_doc, 0.10).when(a_doc & ~k_doc, -0.20).otherwise(0.0)).otherwise(0.0)
    same, other = (left & dl & ~dr) | (right & dr & ~dl), ((left & dr & ~dl) | (right & dl & ~dr)) & ~((left & dl) | (right & dr))
    plain = F.when(F.col("__e.unspecified"), F.when(details, -0.10).otherwise(0.08)).otherwise(0.0)
    total = 0.50 + 0.35 * share + 0.15 * F.col("__m.jac") + F.col("__m.covered") + sharp + F.when(same, 0.15).otherwise(0.0) + plain
    score = F.when(F.col("__e.words").isNull() | F.col("__m.wordless"), 0.0).when(F.col("__m.equal"), 1.0).when((share == 0) | other, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4))
    return met.withColumn("score", score).withColumn("exact", F.col("__m.equal") | ((F.col("score") >= 0.95) & (share >= 0.9)))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (code, description, concept, evidence) with `score` in 0..1 and `exact`."""
    text = F.concat_ws(" ", "concept", F.coalesce("evidence", F.lit("")))
    x = pairs.withColumn("__c", concept_parts(F.col("concept"))).withColumn("__e", entry_parts(F.col("code"), F.col("description"))).withColumn("__bits", text_cues(text))
    return with_score(met_parts(x)).drop("__c", "__e", "__m", "__bits")


def best_match(scored: DataFrame, key: str | list[str], least: float = 0.35) -> DataFrame:
    """The best code of each key (one column or several): the score against a candidate's retrieval score, headers at a discount."""
    s = F.col("score") * F.when(F.coalesce("billable", F.lit(True)), 1.0).otherwise(0.3)
    final = scored.withColumn("final", F.round(0.85 * s + 0.15 * F.coalesce("retrieval_score", F.lit(0.0)), 4)).where(F.col("final") >= least)
    keys = [key] if isinstance(key, str) else key
    return final.groupBy(*keys).agg(F.min_by(F.struct("code", "final", "exact"), F.struct(-F.col("final"), F.col("code"))).alias("b")).select(*keys, "b.*")
