"""Queries over the code catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.operators import catalogue as C
from noteweave.session import table


def _std(spark, d, name="hospital_icd_uploads"):
    return C.standard_rows(table(spark, d, name))


def catalog_normalize_codes(spark, d):
    c = F.col("code")
    return table(spark, d, "hospital_icd_uploads").select("row_id", T.unformat_code(c).alias("clean"), T.format_code(c).alias("formatted"), T.valid_code(c).alias("is_valid"))


def catalog_list_bool_parse(spark, d):
    u = table(spark, d, "hospital_icd_uploads")
    return u.select("row_id", F.array_join(T.parse_list(F.col("inclusion_terms")), "¦").alias("terms"), T.parse_flag(F.col("is_valid_billable")).cast("string").alias("billable"))


def catalog_dedup_merge(spark, d):
    m = C.merge_duplicates(_std(spark, d))
    return m.select("clean", "first_ord", "formatted", "description", F.col("billable").cast("string").alias("billable"), F.array_join("synonyms", "¦").alias("synonyms"), "n_rows")


def catalog_merge_inclusions(spark, d):
    """The merged inclusion terms of each code; catalog_dedup_merge has the columns of its SQL twin, without them."""
    m = C.merge_duplicates(_std(spark, d))
    return m.select("clean", F.array_join("inclusion_terms", "¦").alias("inclusion_terms"), "n_rows")


def catalog_stats(spark, d):
    return C.ingestion_stats(_std(spark, d))


def catalog_lookup_billable(spark, d):
    return C.lookup(_std(spark, d).select("clean").where("clean is not null"), C.merge_duplicates(_std(spark, d, "sample_hospital_icd")))


def catalog_family_prefix(spark, d):
    u = _std(spark, d).where("ok").select(F.explode(F.array(F.col("clean").substr(1, 4), F.concat(F.col("clean").substr(1, 3), F.lit("ZZ")))).alias("prefix"))
    return C.by_family(u, C.merge_duplicates(_std(spark, d, "sample_hospital_icd")))


def catalog_by_category(spark, d):
    s = _std(spark, d, "sample_hospital_icd").where("ok")
    return s.groupBy(F.col("clean").substr(1, 1).alias("chapter")).agg(F.countDistinct("clean").alias("n_codes"), F.count_if("billable").alias("n_billable"))


def excludes_pair_conflicts(spark, d):
    u = table(spark, d, "hospital_icd_uploads")
    coded = u.select(F.col("site_id").alias("group_id"), T.unformat_code(F.col("code")).alias("clean")).where("clean is not null")
    return C.exclusion_conflicts(coded, C.exclusion_edges(table(spark, d, "sample_hospital_icd")))


def catalog_fixed_width(spark, d):
    s = table(spark, d, "sample_hospital_icd")
    line = F.concat(F.lpad(F.col("row_id").cast("string"), 5, "0"), F.lit(" "), F.rpad(T.unformat_code(F.col("code")), 7, " "), F.lit(" "), F.coalesce("is_valid_billable", F.lit("0")).substr(1, 1), F.lit(" "), F.rpad(F.col("description").substr(1, 60), 60, " "), F.lit(" "), F.col("description"))
    return C.parse_fixed_width(s.select(line.alias("value")))


QUERIES = {f.__name__: f for f in (catalog_normalize_codes, catalog_list_bool_parse, catalog_dedup_merge, catalog_merge_inclusions, catalog_stats, catalog_lookup_billable, catalog_family_prefix, catalog_by_category, excludes_pair_conflicts, catalog_fixed_width)}

_CLEAN = "upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))"
_TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def clean_sql(c: str = "code") -> str:
    return _CLEAN.format(c=c)


def formatted_sql(c: str = "code") -> str:
    t, u = _TRIM.format(c=c), clean_sql(c)
    return rf"CASE WHEN {t} = '' THEN '' WHEN regexp_full_match({t}, '\d+') THEN {t} WHEN regexp_full_match({t}, '\d{{4}}[A-Za-z]') THEN upper({t}) WHEN regexp_full_match({t}, '(?i)M[89]\d{{3}}[./]\d') THEN upper({t}) WHEN contains({t}, '.') THEN upper({t}) WHEN length({u}) > 3 AND regexp_matches({u}, '^[A-Z][0-9]') THEN substr({u}, 1, 3) || '.' || substr({u}, 4) ELSE {u} END"


def valid_sql(c: str = "code") -> str:
    return f"regexp_full_match({clean_sql(c)}, '[A-Z][0-9][0-9A-Z]{{1,5}}')"


def list_sql(c: str) -> str:
    t = _TRIM.format(c=c)
    each = _TRIM.format(c="x")
    return f"list_filter(list_transform(CASE WHEN starts_with({t}, '[') THEN coalesce(TRY_CAST(json({t}) AS VARCHAR[]), [{t}]) WHEN contains({t}, ';') THEN string_split({t}, ';') WHEN contains({t}, '|') THEN string_split({t}, '|') ELSE [{t}] END, lambda x: {each}), lambda x: x <> '')"


def flag_sql(c: str = "is_valid_billable") -> str:
    t = f"lower({_TRIM.format(c=c)})"
    return f"CASE WHEN {t} IN ('1','true','yes','y','t','billable') THEN true WHEN {t} IN ('0','false','no','n','f','header','non-billable') THEN false END"


def std_sql(name: str) -> str:
    d = _TRIM.format(c="description")
    return f"SELECT row_id AS ord, {clean_sql()} AS clean, {formatted_sql()} AS formatted, {d} AS description, {flag_sql()} AS billable, {list_sql('synonyms')} AS synonyms, coalesce({valid_sql()}, false) AND coalesce({d} <> '', false) AS ok FROM {name}"


def sql() -> dict[str, str]:
    up, sample = std_sql("hospital_icd_uploads"), std_sql("sample_hospital_icd")
    cat = f"(SELECT clean, arg_min(billable, ord) AS billable FROM ({sample}) WHERE ok GROUP BY clean)"
    return {
        "catalog_normalize_codes": f"SELECT row_id, {clean_sql()} AS clean, {formatted_sql()} AS formatted, {valid_sql()} AS is_valid FROM hospital_icd_uploads",
        "catalog_list_bool_parse": f"SELECT row_id, array_to_string({list_sql('inclusion_terms')}, '¦') AS terms, CAST({flag_sql()} AS VARCHAR) AS billable FROM hospital_icd_uploads",
        "catalog_dedup_merge": f"""
WITH s AS ({up}), o AS (SELECT * FROM s WHERE ok),
e AS (SELECT clean, x, min((ord, i)) AS k FROM (SELECT clean, ord, unnest(synonyms) AS x, generate_subscripts(synonyms, 1) AS i FROM o) GROUP BY ALL)
SELECT o.clean, min(ord) AS first_ord, arg_min(formatted, ord) AS formatted, arg_min(description, ord) AS description, CAST(arg_min_null(billable, ord) AS VARCHAR) AS billable,
coalesce((SELECT string_agg(x, '¦' ORDER BY k) FROM e WHERE e.clean = o.clean), '') AS synonyms, count(*) AS n_rows FROM o GROUP BY o.clean""",
        "catalog_merge_inclusions": f"""
WITH o AS (SELECT row_id AS ord, {clean_sql()} AS clean, {list_sql('inclusion_terms')} AS terms FROM hospital_icd_uploads WHERE coalesce({valid_sql()}, false) AND coalesce({_TRIM.format(c="description")} <> '', false)),
e AS (SELECT clean, x, min((ord, i)) AS k FROM (SELECT clean, ord, unnest(terms) AS x, generate_subscripts(terms, 1) AS i FROM o) GROUP BY ALL)
SELECT o.clean, coalesce((SELECT string_agg(x, '¦' ORDER BY k) FROM e WHERE e.clean = o.clean), '') AS inclusion_terms, count(*) AS n_rows FROM o GROUP BY o.clean""",
        "catalog_stats": f"""
SELECT count(*) AS n_rows, count(*) FILTER (NOT ok) AS n_malformed, count(*) FILTER (ok) AS n_valid, count(DISTINCT clean) FILTER (ok) AS n_codes, count(*) FILTER (ok AND billable) AS n_billable,
count(*) FILTER (ok AND NOT billable) AS n_headers, sum(coalesce(len(synonyms), 0)) FILTER (ok) AS n_synonyms, count(*) FILTER (ok) - count(DISTINCT clean) FILTER (ok) AS n_duplicates FROM ({up})""",
        "catalog_lookup_billable": f"SELECT a.clean, c.clean IS NOT NULL AS code_exists, coalesce(c.billable, false) AS billable FROM (SELECT DISTINCT clean FROM ({up}) WHERE clean IS NOT NULL) a LEFT JOIN {cat} c USING (clean)",
        "catalog_family_prefix": f"""
WITH p AS (SELECT DISTINCT unnest([substr(clean, 1, 4), substr(clean, 1, 3) || 'ZZ']) AS prefix FROM ({up}) WHERE ok), c AS (SELECT clean FROM {cat}),
d AS (SELECT prefix, clean FROM p, c WHERE length(prefix) BETWEEN 3 AND 5 AND starts_with(clean, prefix))
SELECT * FROM d UNION SELECT prefix, clean FROM p, c WHERE prefix NOT IN (SELECT prefix FROM d) AND substr(prefix, 1, 3) = substr(clean, 1, 3)""",
        "catalog_by_category": f"SELECT substr(clean, 1, 1) AS chapter, count(DISTINCT clean) AS n_codes, count(*) FILTER (billable) AS n_billable FROM ({sample}) WHERE ok GROUP BY 1",
        "excludes_pair_conflicts": f"""
WITH e0 AS (SELECT {clean_sql()} AS a, {clean_sql("unnest(regexp_extract_all(exclusion_terms, '[A-Z][0-9][0-9](?:\\.[0-9A-Z]+)?'))")} AS b FROM sample_hospital_icd WHERE exclusion_terms IS NOT NULL),
e AS (SELECT DISTINCT least(a, b) AS code_a, greatest(a, b) AS code_b FROM e0 WHERE a <> b),
c AS (SELECT DISTINCT site_id AS group_id, {clean_sql()} AS clean FROM hospital_icd_uploads WHERE code IS NOT NULL)
SELECT x.group_id, e.code_a, e.code_b FROM e JOIN c x ON x.clean = e.code_a JOIN c y ON y.clean = e.code_b AND y.group_id = x.group_id""",
        "catalog_fixed_width": f"""SELECT {clean_sql()} AS clean, substr(coalesce(is_valid_billable, '0'), 1, 1) = '1' AS billable, trim(substr(description, 1, 60)) AS short_text, trim(description) AS long_text
FROM sample_hospital_icd WHERE description IS NOT NULL AND code IS NOT NULL AND {clean_sql()} <> ''""",
    }
