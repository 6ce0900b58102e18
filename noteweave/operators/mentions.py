"""Mentions of catalogue entries in notes, clause by clause, with polarity and section.

Each description is looked up by its rarest word only; the whole description is then verified at word boundaries. So the
lines meet the catalogue in one hash join on a word, and a word that is common in lines but in no description's rarest place
joins nothing: most such words fall out before, by a set of hashes of a fixed size. The notes' words are far larger than
their files tell, so the join is an outer one, of which only the catalogue's side may be broadcast.

Cases: null and blank lines and descriptions mention nothing; a description that stands twice in a line counts once; of
equal descriptions the smallest code is given; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.operators import notes


def _words(c: str):
    return T.tokens(F.lower(c), r"[\p{L}\p{N}]+")


def rare_words(entries: DataFrame) -> DataFrame:
    """(phrase, code, word): each distinct description as a phrase of words, with its rarest word among all descriptions."""
    e = entries.where("description is not null").select("code", _words("description").alias("ws")).where(F.size("ws") > 0)
    p = e.groupBy(F.array_join("ws", " ").alias("phrase")).agg(F.min("code").alias("code"))
    each = p.select("phrase", "code", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    return each.join(df, "word").groupBy("phrase", "code").agg(F.min_by("word", F.struct("df", "word")).alias("word"))


#: Places of the hashes of rarest words.
SPOTS = 1 << 16
#: Where a clause ends.
CLAUSE = r"[.!?]+\s+|;\s*|,?\s+but\s+|,?\s+although\s+"


def clauses(lines: DataFrame) -> DataFrame:
    """The lines with `clause_no` and `clause`: parts of a line whose cues don't reach the next."""
    return lines.select("*", F.posexplode(F.split("line", CLAUSE)).alias("clause_no", "clause"))


def extract(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, line_no, start_char, section, clause_no, code, phrase, polarity) of every description named in a clause, with the
    polarity of that clause; the question mark at its end counts."""
    rare = rare_words(entries)
    parts = clauses(notes.lines_of(docs)).select("id", "line_no", "start_char", "section", "clause_no", "clause", F.concat(F.lit(" "), F.array_join(_words("clause"), " "), F.lit(" ")).alias("plain"))
    spot = F.pmod(F.xxhash64("word"), F.lit(SPOTS)).alias("spot")
    each = parts.select("*", F.explode(F.array_distinct(F.split(F.trim("plain"), " "))).alias("word")).withColumn("spot", spot)
    some = each.join(F.broadcast(rare.select(spot).distinct()), "spot", "left_semi")  # at most SPOTS rows on the right
    named = F.contains("plain", F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    hit = some.join(rare, "word", "left").where(F.coalesce(named, F.lit(False)))  # a plain condition would make it an inner join
    return hit.select("id", "line_no", "start_char", "section", "clause_no", "code", "phrase", T.polarity(F.col("clause")).alias("polarity"))


def longest(mentions: DataFrame) -> DataFrame:
    """Mentions of a clause without those whose words stand inside a longer one there (by window over the clause: few rows)."""
    w = Window.partitionBy("id", "line_no", "clause_no")
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    others = mentions.withColumn("__all", F.collect_set("phrase").over(w))
    inside = F.exists("__all", lambda p: (p != F.col("phrase")) & F.contains(spaced(p), spaced(F.col("phrase"))))
    return others.where(~inside).drop("__all")
