"""The code catalogue: merging of duplicates, lookups, families, exclusions and ingestion counters.

Cases: rows without a valid code or description are malformed and counted, not loaded; of rows with one code the first
(by ordinal) wins and the lists of the others are appended; null lists are empty; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions import text as T


def standard_rows(rows: DataFrame, ordinal: str = "row_id") -> DataFrame:
    """Catalogue rows with clean and formatted code, flag and lists; `ok` marks loadable ones."""
    return rows.select(
        F.col(ordinal).alias("ord"), T.unformat_code(F.col("code")).alias("clean"), T.format_code(F.col("code")).alias("formatted"), T.trim(F.col("description")).alias("description"),
        T.parse_flag(F.col("is_valid_billable")).alias("billable"), T.parse_list(F.col("synonyms")).alias("synonyms"), T.parse_list(F.col("inclusion_terms")).alias("inclusion_terms"),
        (F.coalesce(T.valid_code(F.col("code")), F.lit(False)) & F.coalesce(T.trim(F.col("description")) != "", F.lit(False))).alias("ok"),
    )


def _lists(c: str) -> Column:
    """The lists of a group in the order of their rows, each value once."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])))


def merge_duplicates(std: DataFrame) -> DataFrame:
    """One row per clean code: the first row's values, all rows' lists; partial aggregation before the shuffle."""
    return std.where("ok").groupBy("clean").agg(
        F.min("ord").alias("first_ord"), F.min_by("formatted", "ord").alias("formatted"), F.min_by("description", "ord").alias("description"), F.min_by("billable", "ord").alias("billable"),
        _lists("synonyms").alias("synonyms"), _lists("inclusion_terms").alias("inclusion_terms"), F.count("*").alias("n_rows"),
    )


def ingestion_stats(std: DataFrame) -> DataFrame:
    merged = std.agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("ok")).alias("n_malformed"), F.count_if("ok").alias("n_valid"), F.countDistinct(F.when(F.col("ok"), F.col("clean"))).alias("n_codes"),
        F.count_if(F.col("ok") & F.col("billable")).alias("n_billable"), F.count_if(F.col("ok") & ~F.col("billable")).alias("n_headers"), F.sum(F.when(F.col("ok"), F.coalesce(F.size("synonyms"), F.lit(0)))).alias("n_synonyms"),
    )
    return merged.withColumn("n_duplicates", F.col("n_valid") - F.col("n_codes"))


def lookup(codes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(clean, exists, billable) for each distinct code asked for; the small side is broadcast by its size only."""
    asked = codes.select("clean").distinct()
    return asked.join(catalogue.select("clean", "billable", F.lit(True).alias("there")), "clean", "left").select("clean", F.coalesce("there", F.lit(False)).alias("code_exists"), F.coalesce("billable", F.lit(False)).alias("billable"))


def by_family(prefixes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(prefix, clean): codes with the prefix; a prefix without any falls back to the family of its first three places."""
    keys = catalogue.select("clean", F.explode(F.array_distinct(F.array(*[F.col("clean").substr(1, n) for n in (3, 4, 5)]))).alias("key"))
    asked = prefixes.select(F.col("prefix")).distinct()
    direct = asked.join(keys, F.col("prefix") == F.col("key")).select("prefix", "clean")
    left = asked.join(direct, "prefix", "left_anti")
    wide = left.join(keys.where(F.length("key") == 3), F.col("prefix").substr(1, 3) == F.col("key")).select("prefix", "clean")
    return direct.unionByName(wide).distinct()


def exclusion_edges(rows: DataFrame) -> DataFrame:
    """(clean, other): codes named in parentheses in the exclusion terms, without trailing wildcard marks."""
    named = F.explode(F.regexp_extract_all("exclusion_terms", F.lit(r"([A-Z][0-9][0-9](?:\.[0-9A-Z]+)?)"), F.lit(1)))
    return rows.where("exclusion_terms is not null").select(T.unformat_code(F.col("code")).alias("clean"), named.alias("o")).select("clean", T.unformat_code(F.col("o")).alias("other")).where("clean <> other").distinct()


def exclusion_conflicts(coded: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, code_a, code_b) with code_a < code_b for codes of one group that exclude each other.

    It starts from the edges, so no pairs of a group's codes are made that no edge names.
    """
    c = coded.select("group_id", "clean").distinct()
    e = edges.select(F.least("clean", "other").alias("code_a"), F.greatest("clean", "other").alias("code_b")).distinct()
    one = e.join(c, F.col("code_a") == F.col("clean")).select("group_id", "code_a", "code_b")
    return one.join(c.withColumnRenamed("clean", "code_b"), ["group_id", "code_b"], "left_semi").select("group_id", "code_a", "code_b")


def parse_fixed_width(lines: DataFrame) -> DataFrame:
    """Order-file lines: code at 7-13, flag at 15, short text at 17-76, long text from 78; shorter than 16 is malformed."""
    v = F.col("value")
    ok = F.length(v) >= 16
    cut = lambda a, n: F.trim(v.substr(a, n))
    return lines.where(ok).select(cut(7, 7).alias("clean"), (v.substr(15, 1) == "1").alias("billable"), cut(17, 60).alias("short_text"), F.trim(v.substr(F.lit(78), F.length(v))).alias("long_text")).where("clean <> ''")
