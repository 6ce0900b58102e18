"""Splitting of oversized texts at natural boundaries (problem 1).

A text over the limit is bisected: it is cut at the strongest boundary near its middle, and each half that is still
over the limit less the overlap is cut again; then each piece but the first is given the end of the one before.

Cases: null texts have no piece; an empty or short text is one piece; a text without any boundary is cut between
characters, never inside a letter with its marks or a carriage return with its line feed. Every text is cut whole: the
pieces without their overlaps, joined, are the text. Rows that stand twice are cut twice.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: The limit of a piece and the most it repeats of the one before, in characters.
LIMIT, OVERLAP = 2000, 200
#: Boundaries from the strongest to the weakest; a cut falls at the end of the match.
BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),  # blank line
    re.compile(r"\n(?=\s*(?:[-*•·]|\d{1,3}[.)])\s)|\n(?=[^\n]{1,60}:[^\S\n]*\n)"),  # before a list item or heading
    re.compile(r"(?<=[.!?…。！？।؟;:])[\"”»’)\]]*\s*\n"),  # end of a line that ends a sentence
    re.compile(r"(?:[!?…؟]|(?<![\s.][^\W\d])\.)[\"”»’)\]]*\s+(?=[^\sa-zà-ÿ])|[。！？।][”」』）]*\s*"),  # end of a sentence
    re.compile(r"\n"),
    re.compile(r"[;:,、，；：،]\s+|[、，；：]"),  # clause
    re.compile(r"\s+"),
]
#: A cut keeps at least this share of the text on either side, where a boundary of that strength lies there.
WINDOW = 0.25

_PIECES = ArrayType(StructType().add("piece_no", IntegerType()).add("start_char", IntegerType()).add("end_char", IntegerType()).add("overlap", IntegerType()).add("piece", StringType()))


def _inside(text: str, at: int) -> bool:
    """Whether a cut at `at` would part a letter from its marks or a line feed from its return."""
    c, b = text[at], text[at - 1]
    return unicodedata.combining(c) > 0 or unicodedata.category(c) in ("Mn", "Me", "Mc") or c in "‍️" or b == "‍" or (b == "\r" and c == "\n")


def _cut(text: str, lo: int, hi: int) -> int:
    """The strongest boundary near the middle of text[lo:hi]; of equal ones the nearest to it."""
    mid, reach = (lo + hi) // 2, max(1, int((hi - lo) * (0.5 - WINDOW)))
    a, b = max(lo + 1, mid - reach), min(hi - 1, mid + reach)
    for pattern in BOUNDARIES:
        best = None
        for m in pattern.finditer(text, max(lo, a - 200), min(hi, b + 200)):
            if a <= m.end() <= b and not _inside(text, m.end()) and (best is None or abs(m.end() - mid) < abs(best - mid)):
                best = m.end()
        if best is not None:
            return best
    at = mid
    while at > lo + 1 and _inside(text, at):
        at -= 1
    return at if at > lo + 1 or not _inside(text, at) else mid


def _overlap(text: str, lo: int, at: int, most: int) -> int:
    """Where the repeated end before `at` starts: at the first sentence, else clause, else word within `most` characters."""
    a = max(lo, at - most)
    if a == lo:
        return a
    for group in (BOUNDARIES[:5], BOUNDARIES[5:6], BOUNDARIES[6:]):
        ends = [m.end() for pattern in group for m in pattern.finditer(text, a, at) if text[m.end() : at].strip() and not _inside(text, m.end())]
        if ends:
            return min(ends)
    while a < at and _inside(text, a):
        a += 1
    return a


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces as (number from 1, start, end, characters repeated); the start counts the repeated ones."""
    if len(text) <= limit:
        return [(1, 0, len(text), 0)]
    todo, cores = [(0, len(text))], []
    while todo:  # the recursion, with its own stack
        lo, hi = todo.pop()
        if hi - lo <= limit - overlap:
            cores.append((lo, hi))
        else:
            at = _cut(text, lo, hi)
            todo += [(at, hi), (lo, at)]
    out = []
    for k, (lo, hi) in enumerate(cores):
        start = _overlap(text, cores[k - 1][0], lo, overlap) if k else lo
        out.append((k + 1, start, hi, lo - start))
    return out


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The pieces of `text`; only texts over the limit go through Python."""

    @pandas_udf(_PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [(n, a, b, o, t[a:b]) for n, a, b, o in split_text(t, limit, overlap)] for t in texts])

    whole = F.array(F.struct(F.lit(1).alias("piece_no"), F.lit(0).alias("start_char"), F.length(text).alias("end_char"), F.lit(0).alias("overlap"), text.alias("piece")))
    long = F.length(text) > limit
    return F.when(text.isNull(), None).when(long, cut(F.when(long, text))).otherwise(whole)


def split_documents(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: id, n_pieces and the fields of a piece."""
    cut = docs.select("id", pieces(F.col("text"), limit, overlap).alias("ps")).where(F.col("ps").isNotNull())
    return cut.select("id", F.size("ps").alias("n_pieces"), F.explode("ps").alias("p")).select("id", "n_pieces", "p.*")
