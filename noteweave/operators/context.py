"""Context of mentions: relevance and eligibility, result rows, checks and plain-text rendering.

Cases: unknown values fall through to ACTIVE; null columns count as unknown; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context(mention_prefix: str = "") -> Column:
    """AMBIGUOUS, RULED_OUT, HISTORICAL, RESOLVED or ACTIVE, in this order of precedence."""
    c = lambda n: F.upper(F.coalesce(F.col(mention_prefix + n), F.lit("")))
    ruled = c("assertion_status").isin("NEGATED", "ABSENT", "RULED_OUT") | (c("certainty") == "RULED_OUT")
    return (
        F.when(c("certainty").isin("AMBIGUOUS", "UNCERTAIN"), "AMBIGUOUS").when(ruled, "RULED_OUT").when(c("temporality").isin("HISTORICAL", "HISTORY", "PAST"), "HISTORICAL").when(c("temporality") == "RESOLVED", "RESOLVED").otherwise("ACTIVE")
    )


def assess(mentions: DataFrame) -> DataFrame:
    """(diagnosis_id, context, eligible): active and ambiguous mentions of authorised terms may be coded."""
    ctx = context()
    return mentions.select("diagnosis_id", ctx.alias("context"), (ctx.isin("ACTIVE", "AMBIGUOUS") & F.coalesce("is_authorized", F.lit(True))).alias("eligible"))


def checks(ranked: DataFrame, coded: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(check, n_failed) of a result: one primary per document, codes known, scores in range. ranked: rank_roles; coded: (term, code, final)."""
    two = ranked.where("final_role = 'PRIMARY'").groupBy("document_id").count().where("count > 1").agg(F.count("*").alias("n_failed"))
    there = coded.join(catalogue.select("code", F.lit(True).alias("there")).distinct(), "code", "left")  # read once for both counts
    counts = there.agg(F.count_if(F.col("there").isNull()).alias("known_code"), F.count_if((F.col("final") < 0) | (F.col("final") > 1)).alias("score_range"))
    of = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_failed")) for n in ("known_code", "score_range")])).alias("c")).select("c.*")
    return two.select(F.lit("one_primary").alias("check"), "n_failed").unionByName(of)


def render(ranked: DataFrame, mentions: DataFrame) -> DataFrame:
    """(document_id, report): one line per mention in its position. A document's mentions make one text."""
    line = F.format_string("%d. [%s] %s (%.3f)", F.col("position"), F.col("final_role"), F.coalesce("raw_term", F.lit("-")), F.col("score"))
    rows = ranked.join(mentions.select("diagnosis_id", "raw_term"), "diagnosis_id").select("document_id", F.struct("position", line.alias("line")).alias("l"))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("report"))


def parse_answer(c: Column, schema: str = "array<struct<term: string, code: string, confidence: double>>") -> Column:
    """JSON from a model's answer: fences and text around the first array are dropped, trailing commas mended; null if it can't be read."""
    body = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.from_json(F.regexp_replace(body, r",\s*([\]}])", "$1"), schema)
