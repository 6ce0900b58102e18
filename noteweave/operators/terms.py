"""Terms: plain names, kinds, polarity of mentions in a text, evidence without repetition, and sides a code demands.

Cases: null terms stay null or count as empty; lists without items stay empty; rows that stand twice are treated alike.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from noteweave.functions import text as T
from noteweave.functions import values as V

#: Kinds of entities with words that mark them, in order of precedence.
KINDS = {
    "PROCEDURE": ["repair", "resection", "biopsy", "excision", "drainage"],
    "NEOPLASM": ["neoplasm", "carcinoma", "cancer", "tumor", "lymphoma", "malignancy"],
    "FRACTURE": ["fracture", "dislocation", "sprain"],
    "INFECTION": ["infection", "abscess", "sepsis", "pneumonia"],
    "INFLAMMATION": ["colitis", "carditis", "dermatitis", "[a-z]+itis"],
    "VASCULAR": ["embolism", "thrombosis", "haematoma", "haemorrhage", "stenosis"],
    "NEURO": ["neuropathy", "paralysis"],
    "SYMPTOM": ["pain", "swelling", "nausea", "unwell", "fever"],
}
#: What is no diagnosis, with the reason.
REJECTED = {
    "administrative": ["medication refill", "social admission", "review in clinic", "bloods pending", "awaiting results"],
    "reference": ["as per previous note", "as coded before", "see above", "known problem"],
    "wellbeing": ["patient doing well"],
    "placeholder": ["n/a", "-", "tbc", "nil", "none"],
}


def plain_name(c: Column) -> Column:
    """A term without list mark, preamble, administrative parenthesis, tail after a dash or end marks; abbreviations written out."""
    s = F.regexp_replace(T.trim(c), r"^(?:[-*•]|\d+[.)])\s*", "")
    for _ in range(3):
        s = F.regexp_replace(s, r"(?i)^(?:h/o|s/p|dx:|known case of|history of|diagnosis:|patient with)\s*", "")
    s = F.regexp_replace(s, r"\((?:[^()]*\d[^()]*|stable|unchanged)\)", " ")
    s = F.regexp_replace(s, r"\s+[-–—]\s+.*$", "")
    s = F.regexp_replace(s, r"[?!.,;:]+$", "")
    s = F.regexp_replace(s, r"\s+", " ")
    return T.trim(F.lower(T.expand_abbreviations(s)))


def query_variations(asked: DataFrame) -> DataFrame:
    """(query_id, variation) of asked (query_id, text, evidence): the plain name, other names of its family, the words
    without qualifiers, with a related word each, with all related words, and up to four words that the evidence shares.
    """
    none, rel = F.array().cast("array<string>"), T.literal_map(V.RELATED)
    word = lambda c: T.tokens(F.lower(c), "[a-z0-9]+")
    x = asked.select("query_id", "text", F.coalesce(plain_name(F.col("text")), F.lit("")).alias("norm"), F.coalesce(plain_name(F.col("evidence")), F.lit("")).alias("ev")).withColumn("ws", word(F.col("norm")))
    x = x.withColumn("core", F.filter("ws", lambda w: ~w.isin(*V.QUALIFIERS))).withColumn("base", F.when(F.size("core") > 0, F.col("core")).otherwise(F.col("ws")))
    family = F.lit(None).cast("array<string>")
    for marks, names in reversed(V.FAMILIES):
        family = F.when(F.col("norm").rlike("|".join(marks)), F.array(*map(F.lit, names))).otherwise(family)
    swapped = F.transform("base", lambda w: F.coalesce(F.try_element_at(rel, w)[0], w))
    shared = F.filter(T.tokens(F.col("ev"), "[a-z0-9]{4,}"), lambda w: F.array_contains(F.col("ws"), w) | F.arrays_overlap(F.coalesce(F.try_element_at(rel, w), none), F.col("ws")))
    related = T.related_tokens(T.clinical_tokens(F.col("text")))
    each = F.concat(
        F.array("norm"), F.coalesce(family, none), F.array(F.array_join("core", " ")), F.array(F.array_join(swapped, " ")), F.array(F.array_join(related, " ")), F.when(F.size(shared) > 1, F.array(F.array_join(F.slice(shared, 1, 4), " "))).otherwise(none)
    )
    return x.select("query_id", "text", F.explode(F.array_distinct(F.transform(each, T.trim))).alias("variation")).where((F.length("variation") >= 2) & (F.col("variation") != F.lower(T.trim(F.col("text"))))).select("query_id", "variation")


def entity_kind(c: Column) -> Column:
    out = F.when(F.coalesce(T.trim(c), F.lit("")) == "", "NONE")
    for kind, words in KINDS.items():
        out = out.when(T.has_cue(c, words), kind)
    return out.otherwise("OTHER")


def reject_reason(c: Column) -> Column:
    """Why a term is no candidate; null for one that may be."""
    t = F.lower(T.trim(c))
    out = F.when(F.coalesce(t, F.lit("")) == "", "empty")
    for reason, terms in REJECTED.items():
        out = out.when(t.isin(terms), reason)
    return out.when(~t.rlike("[a-z]{3}"), "no_word").when(T.has_cue(c, V.NEGATION), "absence")


def side_demand(description: Column, evidence: Column) -> Column:
    """Whether the side that a description names is supported: SUPPORTED, CONTRADICTED, MISSING or NONE."""
    want, have = T.laterality(description), T.laterality(evidence)
    return F.when(want == "NONE", "NONE").when(want == have, "SUPPORTED").when(have == "NONE", "MISSING").otherwise("CONTRADICTED")


def sentences_of(c: Column) -> Column:
    """Sentences of a line-wise text; no cut after an initial or a number."""
    s = F.split(c, r"\n|(?<!\b[A-Za-z])(?<!\b\d)(?<=[.!?])\s+(?=[A-Z0-9])")
    return F.filter(F.transform(s, T.trim), lambda x: x != "")


#: Words of a term that don't tell whether a sentence is about it.
UNTELLING = ("with", "without", "and", "the", "for", "left", "right", "acute", "chronic", "mild", "severe")


def corroborate(named: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, term, evidence) of named (document_id, term, quotes): the quotes, then the document's sentences that
    have at least half of the term's telling words (at least one), as they are or by a related word. What another item
    contains, or contains it, is not added. A document's text meets its terms once, not per term and sentence.
    """
    texts = docs.where("text is not null and document_id is not null").groupBy("document_id").agg(F.min_by("text", "id").alias("text"))
    per = named.where("document_id is not null").groupBy("document_id").agg(F.collect_list(F.struct("term", "quotes")).alias("terms"))
    both = per.join(texts, "document_id", "left").select("document_id", "terms", F.coalesce(sentences_of(F.col("text")), F.array().cast("array<string>")).alias("sentences"))

    def add(batches):
        for pdf in batches:
            out = []
            for doc, terms, sentences in zip(pdf["document_id"], pdf["terms"], pdf["sentences"], strict=True):
                lows = [(s, s.lower()) for s in sentences]
                for t in terms:
                    ws = [w for w in re.findall(r"\b[a-z0-9]{3,}\b", t["term"].lower()) if w not in UNTELLING]
                    forms = [(w, *V.RELATED.get(w, ())) for w in ws]
                    items = [q.strip() for x in t["quotes"] for q in x.split(" | ") if q.strip()]
                    kept = [q.lower() for q in items]
                    for s, low in lows if ws else ():
                        if sum(any(f in low for f in fs) for fs in forms) >= max(1, len(ws) // 2) and not any(low in k or k in low for k in kept):
                            items.append(s)
                            kept.append(low)
                    out.append((doc, t["term"], " | ".join(items)))
            yield pd.DataFrame(out, columns=["document_id", "term", "evidence"])

    alone = named.where("document_id is null").select("document_id", "term", F.array_join("quotes", " | ").alias("evidence"))
    return both.mapInPandas(add, "document_id string, term string, evidence string").unionByName(alone)


@pandas_udf(ArrayType(StringType()))
def without_repetition(lists: pd.Series) -> pd.Series:
    """Evidence items: repeated ones and such as a longer item contains are left out, in order of appearance.

    A longer item takes the place of a shorter one it contains. Items are compared in case-free text.
    """
    out = []
    for items in lists:
        kept: list[str] = []
        seen: set[str] = set()
        for x in items if items is not None else []:
            low = " ".join((x or "").lower().split())
            if not low or low in seen or any(low in k for k in seen):
                continue
            inside = [i for i, k in enumerate(kept) if " ".join(k.lower().split()) in low]
            if inside:
                seen -= {" ".join(kept[i].lower().split()) for i in inside}
                kept[inside[0]] = x.strip()
                kept = [k for i, k in enumerate(kept) if i not in inside[1:]]
            else:
                kept.append(x.strip())
            seen.add(low)
        out.append(kept)
    return pd.Series(out)
