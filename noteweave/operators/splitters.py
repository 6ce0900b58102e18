"""Splitting of written terms: narrative tails, several conditions in one, neighbours without a delimiter, attributes.

All work on distinct terms. What a column expression can say stays in the JVM; compound and adjacent splits go through
Arrow batches, each term once.

Cases: null terms stay null and blank ones give none; delimiters inside parentheses don't split; a part that names no kind
of illness stays with its neighbour; a term without anything to split is returned as it is; terms of any length are whole.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from noteweave.functions import text as T
from noteweave.operators import terms

#: Marks after which a narrative follows a term, the first found counts; and connectors between conditions.
TAIL = r"\s+[-–—]\s+|:\s+|;\s+|\.\s+(?=[A-Z])"
CAUSES = ["secondary to", "due to", "caused by", "complicated by", "associated with", "resulting in", "leading to"]
#: Fixed values: "with" and "and" belong to the name after or before these.
KEPT_WITH = ["fever", "chills", "obstruction", "haemorrhage", "hemorrhage", "perforation", "abscess", "gangrene", "exacerbation", "behaviour", "ketoacidosis", "coma"]
KEPT_AND = [("nausea", "vomiting"), ("head", "neck"), ("ear", "nose"), ("hand", "foot"), ("bone", "marrow"), ("heart", "kidney"), ("mental", "behavioural")]
#: Attributes that are split off, with their patterns.
ATTRIBUTES = {
    "grade": r"\bgrade\s+(?:[1-4]|I{1,3}|IV)\b", "stage": r"\bstage\s+(?:[0-5]|I{1,3}|IV)[ABC]?\b", "marker": r"\b(?:ER|PR|HER2|EGFR|ALK|KRAS|BRAF|PD-L1|Ki-67)\s*(?:positive|negative|mutated|[+-]|\d+\s*%)",
    "lab": r"\((?:Hb|Na|K|CRP|WBC|PSA|HbA1c|creatinine)\s*[:=]?\s*[\d.]+[^)]*\)", "vital": r"\((?:BP|HR|SpO2|T|RR)\s*[:=]?\s*[\d./]+[^)]*\)",
}

_KIND = re.compile("|".join(rf"(?:^|[^a-z0-9])(?:{w})(?:[^a-z0-9]|$)" for ws in terms.KINDS.values() for w in ws))
#: Endings and words of illnesses beyond the kinds of entities.
_ILL = re.compile(r"(?:itis|osis|emia|aemia|pathy|oma|plegia|algia|uria|penia|megaly|ectasis)\b|\b(?:disease|disorder|syndrome|failure|injury|infarction|hypertension|diabetes|mellitus|asthma|stroke|ulcer|cyst|hernia|shock|arrest|deficiency)\b")


def head_of(c: Column) -> Column:
    """The term before its narrative."""
    return T.trim(F.get(F.split(T.trim(c), TAIL, 2), F.lit(0)))


def tail_of(c: Column) -> Column:
    """The narrative after a term, null if there is none."""
    return T.trim(F.get(F.split(T.trim(c), TAIL, 2), F.lit(1)))


def attributes_of(c: Column) -> Column:
    """A struct of the attributes that a term carries, null where it has none."""
    return F.struct(*[F.nullif(F.regexp_extract(c, f"(?i)({p})", 1), F.lit("")).alias(k) for k, p in ATTRIBUTES.items()])


def without_attributes(c: Column) -> Column:
    for p in ATTRIBUTES.values():
        c = F.regexp_replace(c, f"(?i),?\\s*{p}", "")
    return T.trim(F.regexp_replace(c, r"\s+", " "))


def is_condition(part: str) -> bool:
    low = part.lower()
    return bool(_KIND.search(low) or _ILL.search(low))


def _outside(term: str) -> list[str]:
    """A mask of the term: what stands in parentheses as blanks of the same length."""
    out, depth = [], 0
    for c in term:
        depth += c in "(["
        out.append("\x00" if depth else c)
        depth -= c in ")]" and depth > 0
    return out


def _cut(term: str, pattern: str) -> list[str]:
    """Pieces of a term at the matches of a pattern outside parentheses."""
    mask, at, out = "".join(_outside(term)), 0, []
    for m in re.finditer(pattern, mask, re.I):
        out.append(term[at : m.start()])
        at = m.end()
    return [x.strip() for x in [*out, term[at:]] if x.strip()]


def _joined_again(parts: list[str], glue: str) -> list[str]:
    """Parts that name no condition go back to the one before (or after, at the start)."""
    out: list[str] = []
    for p in parts:
        if out and not (is_condition(p) and is_condition(out[-1])):
            out[-1] = f"{out[-1]}{glue}{p}"
        else:
            out.append(p)
    return out


def split_compound(term: str) -> list[str]:
    """The conditions of a term: at list marks, causal connectors, `with` and `and` unless they belong to a name.

    "X metastatic to A and B" gives X metastatic to A, and X metastatic to B.
    """
    if m := re.match(r"(?i)(.+?\bmetasta(?:tic|ses|sis)\s+(?:to|in))\s+(.+)$", term):
        sites = [re.sub(r"(?i)^the\s+", "", x) for x in _cut(m[2], r",\s*(?:and\s+)?|\s+and\s+")]
        return [f"{m[1]} {x}" for x in sites]
    out = []
    for part in _joined_again(_cut(term, r"[;/+,]\s+|\s*\n\s*|;"), ", "):
        for piece in _joined_again(_cut(part, r"\s+(?:" + "|".join(map(re.escape, CAUSES)) + r")\s+"), " due to "):
            kept = "|".join(KEPT_WITH)
            for x in _joined_again(_cut(piece, rf"\s+with\s+(?!(?:acute\s+)?(?:{kept})\b)"), " with "):
                ands = _cut(x, r"\s+and\s+")
                pairs = any(a in x.lower() and b in x.lower() for a, b in KEPT_AND)
                out += [x] if pairs else _joined_again(ands, " and ")
    return list(dict.fromkeys(out))


def split_adjacent(term: str) -> list[str]:
    """Two conditions written one after the other without a delimiter; the cut leaves a condition on both sides.

    Recursive, the first cut whose left side ends in a condition's own word and whose right side starts a new one.
    """
    ws = term.split()
    for k in range(2, len(ws) - 1):
        left, right = " ".join(ws[:k]), " ".join(ws[k:])
        ends = bool(_ILL.search(ws[k - 1].lower())) or bool(_KIND.search(ws[k - 1].lower()))
        starts = not re.match(r"(?i)(?:of|in|with|due|and|or|without|on|by|type|grade|stage|not|nos)\b", ws[k]) and not ws[k].startswith("(")
        if ends and starts and len(ws) - k >= 2 and is_condition(right) and is_condition(left):
            return [left, *split_adjacent(right)]
    return [term]


@pandas_udf(ArrayType(StringType()))
def compounds(values: pd.Series) -> pd.Series:
    """All conditions of a term: compounds, then neighbours."""
    return pd.Series([None if v is None else [y for x in split_compound(v.strip()) for y in split_adjacent(x)] for v in values])
