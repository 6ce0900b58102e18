"""Queries of the general problems 5 and 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteweave.operators import packed_fields, raw_lines
from noteweave.session import table

_LINE = r"""regexp_replace(regexp_replace(coalesce(raw_line, ''), '^\x{FEFF}', ''), '\r+$', '')"""


def p6_found(spark, d):
    return raw_lines.failed_lines(table(spark, d, "hospital_icd_raw"))


def p6_loaded(spark, d):
    rows = raw_lines.loaded_rows(table(spark, d, "hospital_icd_raw"))
    return rows.withColumn("is_valid_billable", F.col("is_valid_billable").cast("string"))


def p6_summary(spark, d):
    judged = raw_lines.judge_lines(table(spark, d, "hospital_icd_raw").select("file_name", "line_no", "raw_line"))
    return judged.groupBy(F.coalesce("reason", F.when(F.col("kind") == "line", "loaded").otherwise(F.col("kind"))).alias("outcome")).agg(F.count("*").alias("n_lines"))


def p5_found(spark, d):
    both = packed_fields.both_catalogues(table(spark, d, "sample_hospital_icd"), table(spark, d, "hospital_icd_uploads"))
    return packed_fields.unpack(both).where("n_items >= 2").select("row_id", "field_name", "item_no", "item").distinct()


def p5_field_sizes(spark, d):
    both = packed_fields.both_catalogues(table(spark, d, "sample_hospital_icd"), table(spark, d, "hospital_icd_uploads"))
    items = packed_fields.unpack(both)
    return items.where("item_no = 1").groupBy("field_name", "n_items").agg(F.count("*").alias("n_fields"))


QUERIES = {"p5_found": p5_found, "p5_field_sizes": p5_field_sizes, "p6_found": p6_found, "p6_loaded": p6_loaded, "p6_summary": p6_summary}


def _judged() -> str:
    """The whole of problem 6 in SQL."""

    def f(sep: str) -> str:
        return f'(?:"(?:[^"]|"")*"|[^"{sep}]*)'

    def pick(make) -> str:
        return f"CASE WHEN lower(file_name) LIKE '%.tsv' THEN {make(chr(92) + 't')} ELSE {make(',')} END"

    def real(sep: str) -> str:
        return "chr(9)" if sep == "\\t" else f"'{sep}'"

    ok = pick(lambda s: f"regexp_full_match(line, '(?s){f(s)}(?:{s}{f(s)})*')")
    cells = pick(lambda s: f"regexp_extract_all({real(s)} || line, '{s}({f(s)})', 1)")
    names = ",".join(raw_lines.FIELDS)
    flags = ", ".join(f"'{x}'" for x in [*raw_lines.TRUE, *raw_lines.FALSE, ""])
    undone = "list_transform(cells, lambda x: CASE WHEN starts_with(x, '\"') THEN replace(substr(x, 2, length(x) - 2), '\"\"', '\"') ELSE x END)"
    return rf"""
WITH a AS (SELECT line_id, line_no, file_name, {_LINE} AS line FROM hospital_icd_raw),
b AS (SELECT *, {ok} AS well, {cells} AS cells FROM a),
c AS (SELECT * REPLACE (CASE WHEN well THEN {undone} END AS cells) FROM b),
d AS (SELECT *, CASE WHEN NOT regexp_matches(line, '\S') THEN 'blank'
  WHEN line_no = 1 OR coalesce(array_to_string(list_transform(cells, lambda x: lower(trim(x))), ',') = '{names}', false) THEN 'header' ELSE 'line' END AS kind FROM c),
j AS (SELECT *, CASE WHEN kind <> 'line' THEN NULL WHEN NOT well THEN 'quoting' WHEN len(cells) <> 7 THEN 'column_count'
  WHEN NOT regexp_full_match(upper(regexp_replace(cells[1], '[^\p{{L}}\p{{N}}]', '', 'g')), '[A-Z][0-9][A-Z0-9]{{1,5}}') THEN 'code'
  WHEN NOT regexp_matches(cells[2], '\p{{L}}') THEN 'description'
  WHEN lower(regexp_replace(cells[3], '^\s+|\s+$', '', 'g')) NOT IN ({flags}) THEN 'billable' END AS reason FROM d)"""


def sql() -> dict[str, str]:
    true, false = (", ".join(f"'{x}'" for x in v) for v in (raw_lines.TRUE, raw_lines.FALSE))
    trim = lambda i: rf"regexp_replace(cells[{i}], '^\s+|\s+$', '', 'g')"
    rest = ", ".join(f"{trim(i + 1)} AS {f}" for i, f in enumerate(raw_lines.FIELDS) if i > 2)
    return {
        "p6_found": _judged() + "\nSELECT DISTINCT line_id, reason FROM j WHERE reason IS NOT NULL",
        "p6_summary": _judged() + "\nSELECT coalesce(reason, CASE WHEN kind = 'line' THEN 'loaded' ELSE kind END) AS outcome, count(*) AS n_lines FROM j GROUP BY 1",
        "p6_loaded": _judged()
        + rf"""
SELECT line_id, upper(regexp_replace(cells[1], '[^\p{{L}}\p{{N}}]', '', 'g')) AS code, {trim(2)} AS description,
CASE WHEN lower({trim(3)}) IN ({true}) THEN 'true' WHEN lower({trim(3)}) IN ({false}) THEN 'false' END AS is_valid_billable, {rest}
FROM j WHERE kind = 'line' AND reason IS NULL""",
    }
