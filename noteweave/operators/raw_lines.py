"""Parsing of delimited catalogue lines, with failed lines set apart (problem 6).

Every line is taken apart in one JVM pass, whose result is cut; the three typed columns are judged once per distinct
value, all three in one aggregation, and the invalid values (a small dictionary with a reason each) are joined back.

Cases: a null or blank line and a header are neither valid nor failed. A line of an unknown file name counts as
comma-separated. Lines that stand twice are judged twice. Extra input columns are carried along under their own names;
an input column with the name of an output column is replaced. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.session import cut

#: The seven columns of a catalogue file, in order.
FIELDS = ["code", "description", "is_valid_billable", "category", "inclusion_terms", "exclusion_terms", "synonyms"]
#: What counts as true and as false in is_valid_billable.
TRUE = ["1", "true", "yes", "t", "y", "billable"]
FALSE = ["0", "false", "no", "f", "n", "header", "non-billable"]
#: Reasons, in the order in which they apply.
REASONS = ["quoting", "column_count", "code", "description", "billable"]

_EDGE = r"(?U)^\s+|\s+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _field(sep: str) -> str:
    """One field as RFC 4180 has it: wholly quoted with doubled quotes inside, or without any quote."""
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{sep}]*+)'


def _taken_apart(line: Column, tabbed: Column) -> Column:
    """(cells, well): the fields found from the start on, and whether nothing is left over; a line without quotes is split."""

    def by_sep(make) -> Column:
        return F.when(tabbed, make("\t")).otherwise(make(","))

    # one match each for the fields in a row; the line is well-formed if they cover it
    quoted = by_sep(lambda s: F.regexp_extract_all(F.concat(F.lit(s), line), F.lit(rf"\G{s}({_field(s)})"), F.lit(1)))
    plain = by_sep(lambda s: F.split(line, s))
    return F.when(line.contains('"'), quoted).otherwise(plain)


def split_lines(lines: DataFrame) -> DataFrame:
    """Add `kind` ('blank', 'header', 'line'), `structure` (null, 'quoting', 'column_count') and the seven fields."""
    raw = F.regexp_replace(F.regexp_replace(F.coalesce("raw_line", F.lit("")), r"^\x{FEFF}", ""), r"\r+$", "")
    tabbed = F.coalesce(F.lower("file_name").endswith(".tsv"), F.lit(False))
    line, cells = F.col("__line"), F.col("__cells")
    covered = F.aggregate(cells, F.lit(0), lambda n, x: n + F.length(x) + 1) == F.length(line) + 1
    undone = F.transform(cells, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    names = F.array_join(F.transform("__undone", lambda x: F.lower(_trim(x))), ",")
    header = F.coalesce(F.col("line_no") == 1, F.lit(False)) | F.coalesce((F.size("__undone") == len(FIELDS)) & F.lower(line).contains(FIELDS[2]) & (names == ",".join(FIELDS)), F.lit(False))
    out = (
        lines.drop("__line", "__cells", "__undone", "kind", "structure", *FIELDS)
        .withColumn("__line", raw)
        .withColumn("__cells", _taken_apart(line, tabbed))
        .withColumn("__undone", F.when(covered, undone))
        .withColumn("kind", F.when(~line.rlike(r"(?U)\S"), "blank").when(header, "header").otherwise("line"))
        .withColumn("structure", F.when(F.col("__undone").isNull(), "quoting").when(F.size("__undone") != len(FIELDS), "column_count"))
    )
    for i, f in enumerate(FIELDS):
        out = out.withColumn(f, F.when((F.col("kind") == "line") & F.col("structure").isNull(), F.get("__undone", F.lit(i))))
    return out.drop("__line", "__cells", "__undone")


def clean_code(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def _invalid(field: str, value: Column) -> Column:
    if field == "code":
        return ~clean_code(value).rlike(r"\A[A-Z][0-9][A-Z0-9]{1,5}\z")
    if field == "description":
        return ~value.rlike(r"\p{L}")
    return ~F.lower(_trim(value)).isin(*TRUE, *FALSE, "")


#: The typed columns with their reason and the flag that marks an invalid value.
_TYPED = {"code": "code", "description": "description", "is_valid_billable": "billable"}


def invalid_values(parsed: DataFrame) -> DataFrame:
    """The dictionary (`field`, `value`, `reason`) of the distinct values that don't cast, over all lines."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(r).alias("reason")) for f, r in _TYPED.items()])).alias("v")
    wrong = F.lit(False)
    for f in _TYPED:
        wrong = F.when(F.col("field") == f, _invalid(f, F.col("value"))).otherwise(wrong)
    return parsed.select(each).select("v.*").where("value is not null").distinct().where(wrong)


def judge_lines(lines: DataFrame) -> DataFrame:
    """All lines with their fields and `reason`: null for loaded rows, blanks and headers, else the first that applies."""
    parsed = cut(split_lines(lines))
    bad = invalid_values(parsed)
    flags = {f: f"__no_{r}" for f, r in _TYPED.items()}
    out = parsed.drop(*flags.values())
    for f, flag in flags.items():
        one = bad.where(F.col("field") == f).select(F.col("value").alias(f"__v_{f}"), F.lit(True).alias(flag))
        out = out.join(one, F.col(f) == F.col(f"__v_{f}"), "left").drop(f"__v_{f}")
    first = F.when(F.col("structure").isNotNull(), F.col("structure"))
    for f, r in _TYPED.items():
        first = first.when(F.col(flags[f]), r)
    return out.withColumn("reason", F.when(F.col("kind") == "line", first)).drop("structure", *flags.values())


def failed_lines(lines: DataFrame) -> DataFrame:
    return judge_lines(lines.select("line_id", "file_name", "line_no", "raw_line")).where(F.col("reason").isNotNull()).select("line_id", "reason").distinct()


def loaded_rows(lines: DataFrame) -> DataFrame:
    """The rows that parse: code in upper case without stray marks, billable as boolean (null where empty)."""
    flag = F.lower(_trim(F.col("is_valid_billable")))
    rows = judge_lines(lines.select("line_id", "file_name", "line_no", "raw_line")).where((F.col("kind") == "line") & F.col("reason").isNull())
    return rows.select(
        "line_id",
        clean_code(F.col("code")).alias("code"),
        _trim(F.col("description")).alias("description"),
        F.when(flag.isin(*TRUE), True).when(flag.isin(*FALSE), False).alias("is_valid_billable"),
        *[_trim(F.col(f)).alias(f) for f in FIELDS[3:]],
    )
