"""Ordered rules: the first that applies decides; code checks and checks over the codes of one encounter.

Rules are rows (ordinal, outcome, condition); conditions are columns, so a whole rule table is one projection without any
join. Rules that come as a table of patterns are matched in one pass over the distinct values.

Cases: a null condition does not apply; a row that no rule fits has a null outcome; empty rule tables give null outcomes;
codes that stand twice in one encounter count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.operators import catalogue, terms

#: Outcomes of the code checks in the order in which they apply.
NO_CANDIDATE, INVALID, HEADER, LOW, SIDE, VALID = "NO_MATCHING_ICD_CANDIDATE", "INVALID_ICD_CODE", "SPECIFICITY_REQUIRED", "LOW_CONFIDENCE", "LATERALITY_CONTRADICTED", "VALIDATED"
#: Fixed value: scores below it abstain.
LEAST = 0.35


def first_rule(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The outcome of the first rule whose condition holds."""
    out = F.lit(otherwise)
    for outcome, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), outcome).otherwise(out)
    return out


def match_patterns(values: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """(column, outcome) of each distinct value by a table of rules (ordinal, pattern, outcome): the smallest ordinal wins.

    The rules are few and read once; the values stay distributed. Patterns are regular expressions, in any case.
    """
    rows = [(r["pattern"], r["outcome"]) for r in rules.orderBy("ordinal").collect()]  # a rule table
    each = values.select(column).where(F.col(column).isNotNull()).distinct()
    return each.withColumn("outcome", first_rule([(o, F.col(column).rlike(f"(?i){p}")) for p, o in rows]))


def validate_codes(selections: DataFrame, merged: DataFrame) -> DataFrame:
    """selections (key, code, score, term) with `outcome`, against the merged catalogue (one row per clean code).

    No code, no entry of that code, an entry that is a header, a score below `LEAST`, a side other than the term's; else
    validated. Null scores are not checked.
    """
    cat = merged.select("clean", F.col("description").alias("__description"), F.coalesce("billable", F.lit(False)).alias("__billable"))
    both = selections.withColumn("clean", T.unformat_code(F.col("code"))).join(cat, "clean", "left")
    side = terms.side_demand(F.col("__description"), F.col("term"))
    rules = [
        (NO_CANDIDATE, F.coalesce(F.col("clean"), F.lit("")) == ""), (INVALID, F.col("__description").isNull()), (HEADER, ~F.col("__billable")), (LOW, F.col("score") < LEAST), (SIDE, side == "CONTRADICTED"),
    ]
    return both.withColumn("outcome", first_rule(rules, VALID)).select("key", "outcome")


def validate_encounter(coded: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, check, n) of the encounters' violations: several primary codes, none, codes that exclude each other.

    coded: group_id, clean, role.
    """
    per = coded.groupBy("group_id").agg(F.countDistinct(F.when(F.col("role") == "PRIMARY", F.col("clean"))).alias("p"))
    many = per.where("p > 1").select("group_id", F.lit("MULTIPLE_PRIMARY").alias("check"), F.col("p").alias("n"))
    none = per.where("p = 0").select("group_id", F.lit("NO_PRIMARY").alias("check"), F.lit(1).cast("bigint").alias("n"))
    conflicts = catalogue.exclusion_conflicts(coded, edges).groupBy("group_id").agg(F.count("*").alias("n")).select("group_id", F.lit("EXCLUDED_PAIR").alias("check"), "n")
    return many.unionByName(none).unionByName(conflicts)
