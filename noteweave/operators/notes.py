"""Notes: sections, offsets, cues and the documents' mentions.

Cases: null and blank texts have no sections; text before the first heading is GENERAL; quotes that stand nowhere have a
null position; mentions without a confidence score as 0; empty tables give empty results.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from noteweave.functions import text as T
from noteweave.functions import values as V


def section_regex(pattern: str) -> str:
    """The pattern of a line that opens a section."""
    return rf"(?i)^\s*{pattern}\s*(?::|--|$)"




_LOCAL = {h: name for name, heads in V.LOCAL_HEADINGS.items() for h in heads}
_HEADING = [(name, re.compile(section_regex(pattern))) for name, pattern in V.SECTION_PATTERNS]
_ANY_HEADING = re.compile("|".join(f"(?:{section_regex(p).replace('(?i)', '')})" for _, p in V.SECTION_PATTERNS), re.I)


def section_of(line: str) -> str | None:
    """The section that a line opens: a heading with a colon, dashes or nothing after it; dates are no headings."""
    s = line.replace("\r", " ").replace("\t", " ")
    bare = re.sub(r" *:$", "", s.strip(" "))
    if bare in _LOCAL:
        return _LOCAL[bare]
    if not _ANY_HEADING.match(s) or re.match(r"(?i)\s*date of", s):
        return None
    return next(name for name, pattern in _HEADING if pattern.match(s))


_LINES = ArrayType(StructType().add("line_no", IntegerType()).add("start_char", LongType()).add("line", StringType()).add("opens", StringType()).add("section", StringType()))


@pandas_udf(_LINES)
def _taken_apart(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        rows, at, section = [], 0, "GENERAL"
        for k, line in enumerate(t.split("\n")):
            opens = section_of(line)
            section = opens or section
            rows.append((k, at, line, opens, section))
            at += len(line) + 1
        out.append(rows)
    return pd.Series(out)


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, line_no, start_char, line, opens, section) of each text, without any shuffle: offsets (from 0) and sections are
    found within the row."""
    return docs.where("text is not null").select("id", F.explode(_taken_apart("text")).alias("l")).select("id", "l.*")


def sections(docs: DataFrame) -> DataFrame:
    """(id, section_no, section, start_char, end_char): from each heading to the next, within the row."""
    ls = docs.where("text is not null").select("id", F.length("text").cast("bigint").alias("size"), _taken_apart("text").alias("ls"))
    heads = F.filter("ls", lambda x: x["opens"].isNotNull() | (x["line_no"] == 0))
    cut = ls.select("id", "size", F.transform(heads, lambda x: F.struct(x["section"].alias("section"), x["start_char"].alias("start_char"))).alias("hs"))
    end = lambda i: F.coalesce(F.get("hs", i + 1)["start_char"], F.col("size"))
    spans = F.transform("hs", lambda h, i: F.struct((i + 1).alias("section_no"), h["section"].alias("section"), h["start_char"].alias("start_char"), end(i).alias("end_char")))
    return cut.select("id", F.explode(spans).alias("s")).select("id", "s.*")


def section_at(points: DataFrame, secs: DataFrame) -> DataFrame:
    """(key, section) of points (key, id, at): the last section that starts at or before the point.

    An as-of join by sorting both sides together: one window pass, no pairs of points and sections.
    """
    a = secs.select("id", F.col("start_char").alias("at"), "section", F.lit(None).cast("bigint").alias("key"), F.lit(0).alias("side"))
    b = points.select("id", F.col("at").cast("bigint").alias("at"), F.lit(None).cast("string").alias("section"), "key", F.lit(1).alias("side"))
    w = Window.partitionBy("id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("section", F.last("section", ignorenulls=True).over(w)).where("side = 1").select("key", "section")


def high_yield(docs: DataFrame) -> DataFrame:
    """(id, n_sections, n_chars): the sections that coding reads first, by their lengths."""
    s = sections(docs).where(F.col("section").isin(*V.HIGH_YIELD))
    return s.groupBy("id").agg(F.count("*").alias("n_sections"), F.sum(F.col("end_char") - F.col("start_char")).alias("n_chars"))


def admitting_score(c: DataFrame) -> Column:
    """A sum of plain terms over columns; missing values count 0."""
    role = F.when(F.col("role") == "PRIMARY", 10.0).when(F.col("role") == "SECONDARY", -5.0).otherwise(0.0)
    when = F.when(F.col("temporality") == "HISTORICAL", -10.0).otherwise(0.0)
    sure = F.when(F.col("certainty") == "CONFIRMED", 1.0).when(F.col("certainty").isin("SUSPECTED", "PROBABLE", "POSSIBLE"), 0.5).otherwise(0.0)
    sharp = F.when(T.acuity(F.col("raw_term")).isin("ACUTE", "ACUTE_ON_CHRONIC"), 2.0).otherwise(0.0)
    kind = F.when(F.col("entity_type").isin("SYMPTOM", "INFECTION"), -2.0).otherwise(0.0)
    return role + when + sure + sharp + kind + F.floor(F.coalesce("candidate_confidence", F.lit(0.0)) * 1000 + 0.5) / 1000


def latest_mentions(c: DataFrame) -> DataFrame:
    """Each diagnosis once: the version that came last, by max_by so that it combines before the shuffle."""
    cols = [x for x in c.columns if x != "diagnosis_id"]
    rank = F.struct("received_at", F.coalesce("raw_term", F.lit("")), F.coalesce("role", F.lit("")), F.coalesce("candidate_confidence", F.lit(-1.0)))
    return c.groupBy("diagnosis_id").agg(F.max_by(F.struct(*cols), rank).alias("s")).select("diagnosis_id", "s.*")


def rank_roles(mentions: DataFrame) -> DataFrame:
    """(document_id, diagnosis_id, score, position, final_role): the first eligible is PRIMARY, the rest SECONDARY."""
    ok = mentions.where(F.coalesce(F.col("assertion_status") != "NEGATED", F.lit(True)) & F.coalesce("is_authorized", F.lit(True))).withColumn("score", admitting_score(mentions))
    w = Window.partitionBy("document_id").orderBy(F.col("score").desc(), "diagnosis_id")
    r = ok.withColumn("position", F.row_number().over(w))
    return r.select("document_id", "diagnosis_id", F.round("score", 3).alias("score"), "position", F.when(F.col("position") == 1, "PRIMARY").otherwise("SECONDARY").alias("final_role"))


def reconcile(mentions: DataFrame) -> DataFrame:
    """One mention per document and term: negated ones first, then confirmed current ones, then the surest."""
    term = F.lower(F.trim("raw_term"))
    pri = F.when(F.col("assertion_status") == "NEGATED", 0).when((F.col("certainty") == "CONFIRMED") & (F.col("temporality") == "CURRENT"), 1).otherwise(2)
    best = F.min_by(F.struct("diagnosis_id", "assertion_status", "certainty"), F.struct(pri, -F.coalesce("candidate_confidence", F.lit(0.0)), F.col("diagnosis_id")))
    return mentions.where(term != "").groupBy("document_id", term.alias("term")).agg(best.alias("b"), F.count("*").alias("n_mentions")).select("document_id", "term", "b.*", "n_mentions")


def merge_quotes(snippets: DataFrame) -> DataFrame:
    """(diagnosis_id, quotes, n_quotes): the distinct quotes of a diagnosis in order of their place, joined."""
    s = snippets.where("diagnosis_id is not null and trim(quote) <> ''").select("diagnosis_id", F.coalesce("start_char", F.lit(-1)).alias("at"), F.trim("quote").alias("q"))
    first = s.groupBy("diagnosis_id", "q").agg(F.min("at").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "q"))), lambda x: x["q"])
    return first.groupBy("diagnosis_id").agg(F.array_join(ordered, " | ").alias("quotes"), F.count("*").alias("n_quotes"))


def locate_quotes(snippets: DataFrame, docs: DataFrame) -> DataFrame:
    """(snippet_id, found_at, agrees): where a quote stands in its document and whether the given span says the same."""
    first = docs.where("text is not null and document_id is not null").groupBy("document_id").agg(F.min("id").alias("id"))  # ids only are shuffled
    one = docs.where("text is not null").select("id", "text").join(first, "id")
    s = snippets.where("trim(quote) <> ''").groupBy("snippet_id").agg(F.max_by(F.struct("document_id", F.trim("quote").alias("quote"), "start_char"), F.struct("received_at", "quote")).alias("s")).select("snippet_id", "s.*")
    at = T.verbatim_start(F.col("text"), F.col("quote"))
    return s.join(one, "document_id").select("snippet_id", at.alias("found_at"), F.coalesce(at == F.col("start_char"), F.lit(False)).alias("agrees"))
