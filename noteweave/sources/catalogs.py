"""Readers of code catalogues: delimited, JSON, fixed width, spreadsheets; one dispatcher; writers.

All give the seven catalogue columns as strings plus `row_id` (the order of the rows). Column names are matched against
fixed alias lists, in a fixed order of preference; a source without a code or description column is refused.

Cases: a byte-order mark at the start is ignored; broken delimited lines go to `read_lines` and the line parser instead;
an empty file with a header gives an empty table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.operators.catalogue import parse_fixed_width
from noteweave.operators.raw_lines import FIELDS

#: Names a column may have in a source, the preferred first.
ALIASES = {
    "code": ["code", "icd_code", "icd10_code", "diagnosis_code", "icd"],
    "description": ["description", "long_description", "desc", "name", "title", "short_description"],
    "is_valid_billable": ["is_valid_billable", "billable", "is_billable", "valid", "active_yesno"],
    "category": ["category", "chapter", "icd10_code_cat3", "parent_code"],
    "inclusion_terms": ["inclusion_terms", "includes", "inclusions"],
    "exclusion_terms": ["exclusion_terms", "excludes", "exclusions", "excludes1"],
    "synonyms": ["synonyms", "aliases", "synonym"],
}


class MissingColumns(ValueError):
    """A source lacks a code or a description column."""


def standardize(df: DataFrame) -> DataFrame:
    """The seven columns as strings, by the aliases; a missing optional column is null."""
    have = {c.strip().lower().lstrip("\ufeff").replace(" ", "_"): c for c in df.columns}
    picked = {f: next((have[a] for a in names if a in have), None) for f, names in ALIASES.items()}
    missing = [f for f in ("code", "description") if picked[f] is None]
    if missing:
        raise MissingColumns(f"Missing required columns: {', '.join(missing)}")
    text = lambda f: F.col(f"`{picked[f]}`") if picked[f] else F.lit(None)
    kinds = dict(df.dtypes)
    as_text = lambda f: F.to_json(text(f)) if picked[f] and kinds[picked[f]].startswith(("array", "struct")) else text(f).cast("string")
    return df.select(F.monotonically_increasing_id().alias("row_id"), *[as_text(f).alias(f) for f in FIELDS])


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    sep = sep or ("\t" if path.lower().endswith(".tsv") else ",")
    return standardize(spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or an object with the array under `records`."""
    df = spark.read.json(path, multiLine=True)
    return standardize(df.select(F.explode("records").alias("r")).select("r.*") if "records" in df.columns else df)


def read_fixed_width(spark: SparkSession, path: str) -> DataFrame:
    p = parse_fixed_width(spark.read.text(path))
    return standardize(p.select(F.col("clean").alias("code"), F.coalesce(F.nullif("long_text", F.lit("")), "short_text").alias("description"), F.when(F.col("billable"), "1").otherwise("0").alias("is_valid_billable")))


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """All sheets with a code and a description column, active rows only. Needs pandas' spreadsheet reader.

    A workbook is one small file, read on the driver.
    """
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise RuntimeError("spreadsheets need openpyxl") from e
    out = None
    for sheet in pd.read_excel(path, sheet_name=None, dtype=str).values():
        low = {c.strip().lower() for c in sheet.columns}
        if not low & set(ALIASES["code"]) or not low & set(ALIASES["description"]):
            continue
        one = standardize(spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None)))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise MissingColumns("Missing required columns: code, description")
    return out.where(F.coalesce(~F.lower("is_valid_billable").isin("no", "n", "inactive"), F.lit(True)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of site files for the line parser: file_name, line_no, raw_line. Each file's order is kept."""
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("i", "raw_line"))
    return raw.select(F.xxhash64("file_name", "i").alias("line_id"), "file_name", (F.col("i") + 1).cast("int").alias("line_no"), "raw_line").where("raw_line <> ''")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .json, .xlsx/.xls, .txt (fixed width), else delimited; a folder gives all its files in the order of names."""
    files = files_in(spark, path)
    if files is not None:
        return read_files(spark, files)
    suffix = os.path.splitext(path)[1].lower()
    reader = {".json": read_json, ".xlsx": read_spreadsheet, ".xls": read_spreadsheet, ".txt": read_fixed_width}.get(suffix, read_delimited)
    return reader(spark, path)


#: Suffixes of catalogue files in a folder.
SUFFIXES = (".csv", ".tsv", ".json", ".xlsx", ".xls", ".txt")


def files_in(spark: SparkSession, path: str) -> list[str] | None:
    """The catalogue files of a folder (on whatever file system Spark reads), sorted; None if the path is no folder."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return None
    return sorted(str(f.getPath()) for f in fs.listStatus(where) if f.isFile() and str(f.getPath().getName()).lower().endswith(SUFFIXES))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files as one catalogue: rows of an earlier file come first (by row_id), so that the first of a code wins."""
    out = spark.createDataFrame([], "row_id long, " + ", ".join(f"{f} string" for f in FIELDS))
    for k, path in enumerate(paths):
        one = read_catalog(spark, path)
        out = out.unionByName(one.withColumn("row_id", F.col("row_id") + F.lit(k << 50)))
    return out


def write_catalog(df: DataFrame, folder: str) -> None:
    """The catalogue as Parquet, by chapter, so that a filter on it reads one folder."""
    df.withColumn("chapter", F.upper(F.substring("code", 1, 1))).write.mode("overwrite").partitionBy("chapter").parquet(folder)


def write_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Postings, lengths, idf and vectors of retrieval as Parquet tables."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
