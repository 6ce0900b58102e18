"""Freely typed terms mapped to the entries of a reference list (problem 2).

A prefix-filter set-similarity join, twice. First words: a word's set holds its letter pairs and letters; a typed word
meets the words of the list only through two of its rarest members at once, past length and positional filters, and of
those whose Jaccard similarity (verified exactly) is high enough the nearest by edits is kept. Then terms: a term's set holds its
words so corrected; it meets the descriptions and synonyms through its rarest words, the Jaccard similarity is verified
exactly and the best entry is kept. An entry is meant only if no word of substance is left over on either side.

Scale: only distinct terms and distinct words are compared; members are ordered by their rarity over all words. Letter
pairs come from a small alphabet, so the key of the word join is a pair of members: postings are short. All joins are
hash joins, with no cross join. Nothing is collected but the fixed lists.

Cases: null and blank terms decide nothing; if raw_term says too little (no entry, or entries of several codes),
normalized_diagnosis decides; if both do, the code is UNMATCHED. Ties go to the smaller code. An empty reference list
leaves all unmatched. Redelivered candidates give the same row, once.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from noteweave.operators import packed_fields
from noteweave.session import cut

#: Least Jaccard similarity of two words and of two terms.
WORDS_ALIKE, TERMS_ALIKE = 0.5, 0.7
#: Members that two words, and two terms, must share within their prefixes (longer by as many less one): the join key.
WORDS_SHARE, TERMS_SHARE = 2, 1
UNMATCHED = "UNMATCHED"
#: What is written around a term without changing it.
AROUND = [
    r"^\s*\d+[.)]\s+", r"\bh/o\b", r"\bs/p\b", r"\bdx\s*:", r"\bknown case of\b", r"\bk/c/o\b", r"\bc/o\b", r"\(stable\)", r"-\s*on treatment\b", r"\bon treatment\b",
    r"[-,]?\s*\bunder review\b", r"\bnos\b", r"\bhistory of\b", r"\bstatus post\b", r"\bdiagnosis\s*:",
]
#: Short forms and other spellings.
SHORT = {
    "rt": "right", "r": "right", "lt": "left", "l": "left", "ac": "acute", "subac": "subacute", "chr": "chronic", "chron": "chronic", "rec": "recurrent", "recurr": "recurrent",
    "cong": "congenital", "postproc": "postprocedural", "postop": "postprocedural", "infect": "infection", "infxn": "infection", "inf": "infection", "fx": "fracture", "fract": "fracture",
    "haem": "haemorrhage", "hem": "haemorrhage", "edema": "oedema", "anemia": "anaemia", "hematoma": "haematoma", "hemorrhage": "haemorrhage", "hyperglycemia": "hyperglycaemia",
    "after": "following", "bilat": "bilateral", "unspec": "unspecified",
}
#: Signs for whole words.
SIGNS = {r"\bw/o\b": " without ", r"\bs/(?=\s)": " without ", r"\bw/(?=\s)": " with ", r"\bc/(?=\s)": " with ", r"\bd/t\b": " due to ", r"\bd/c\b": " ", r"&": " and "}
#: Words without substance, and words that may be missing.
EMPTY = {"of", "the", "in", "to", "a", "an", "and", "or"}
MAY_LACK = ["with", "without", "following", "due"]

_AROUND = [re.compile(p, re.I) for p in AROUND]
_SIGNS = [(re.compile(p, re.I), w) for p, w in SIGNS.items()]
_ANY = re.compile("|".join([*AROUND, *SIGNS]), re.I)


def _fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def term_words(text: str | None) -> list[str]:
    """The words of a term: folded, short forms written out, what stands around it and empty words left out."""
    if text is None:
        return []
    s = _fold(text)
    if _ANY.search(s):
        for p in _AROUND:
            s = p.sub(" ", s)
        for p, w in _SIGNS:
            s = p.sub(w, s)
    s = re.sub(r"\b(post|sub)-(?=[a-z])", r"\1", s)
    s = re.sub(r"['’]s\b", "", s)
    out = []
    for w in re.findall(r"[^\W_]+", s):
        w = SHORT.get(w, w)
        if w not in EMPTY and w not in out:
            out.append(w)
    return out


def word_members(word: str) -> list[str]:
    """The set of a word: its pairs of neighbouring letters, with edges, and its letters, numbered where they recur."""
    padded = f"^{word}$"
    pairs = [padded[i : i + 2] for i in range(len(padded) - 1)]
    out, seen = [], {}
    for x in [*pairs, *word]:
        seen[x] = seen.get(x, 0) + 1
        out.append(x if seen[x] == 1 else f"{x}{seen[x]}")
    return out


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return min(last[-1], most + 1)


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2 if len(word) < 13 else 3


words_udf = pandas_udf(lambda s: pd.Series([term_words(x) for x in s]), ArrayType(StringType()))
members_udf = pandas_udf(lambda s: pd.Series([word_members(x) for x in s]), ArrayType(StringType()))


def slips(typed: str, listed: str) -> int | None:
    """The edits between two words, None if there are too many; numbers inside words are never slips."""
    if re.findall(r"\d+", typed) != re.findall(r"\d+", listed):
        return None
    n = edits(typed, listed, edits_allowed(listed))
    return n if n <= edits_allowed(listed) else None


@pandas_udf(IntegerType())
def slips_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([slips(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def aliases(reference: DataFrame) -> DataFrame:
    """(code, alias, exact): descriptions and single synonyms; exact marks abbreviations, which allow no slip."""
    described = reference.where(F.col("description").rlike(r"\p{L}")).select("code", F.col("description").alias("alias"))
    lists = packed_fields.unpack(reference.select("row_id", *packed_fields.FIELDS)).where("field_name = 'synonyms'")
    named = reference.select("row_id", "code").join(lists.select("row_id", F.col("item").alias("alias")), "row_id").select("code", "alias")
    both = described.unionByName(named).where("code is not null").distinct()
    return both.withColumn("exact", F.col("alias").rlike(r"^[A-Z]{2,}x?(?:-?\d+)?$"))


def _keys(sets: DataFrame, key: str, rarity: DataFrame, least: float, share: int) -> DataFrame:
    """(key, n, position, k): the join keys of a set's prefix, its rarest members or pairs of them, with their first place.

    The prefix is so long that two sets alike enough share `share` of it. Sets so small that they may be alike by a single
    member also have single members as keys.
    """
    each = sets.select(key, F.size("members").alias("n"), F.explode("members").alias("member")).join(rarity, "member")
    ordered = each.groupBy(key, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("rarity", "member"))), lambda x: x["member"]).alias("ms"))
    prefix = lambda more: F.slice("ms", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + more).cast("int"))
    single = F.transform(prefix(1), lambda m, i: F.struct((i + 1).alias("position"), F.xxhash64(m).alias("k")))
    if share == 1:
        keys = single
    else:
        pairs = F.flatten(F.transform(prefix(2), lambda m, i: F.transform(F.slice(prefix(2), i + 2, F.size("ms")), lambda o: F.struct((i + 1).alias("position"), F.xxhash64(F.least(m, o), F.greatest(m, o)).alias("k")))))
        keys = F.when(F.col("n") <= int(1 / least) / least, F.concat(pairs, single)).otherwise(pairs)
    return ordered.select(key, "n", F.explode(keys).alias("e")).select(key, "n", "e.*")


def similar(left: DataFrame, right: DataFrame, lkey: str, rkey: str, least: float, share: int) -> DataFrame:
    """The prefix-filter join: pairs of keys with their exact Jaccard similarity. Both sides: key and array `members`.

    `share` 1 joins on single members of the prefixes, 2 on pairs of members.
    """
    rarity = left.select(F.explode("members").alias("member")).unionByName(right.select(F.explode("members").alias("member"))).groupBy("member").agg(F.count("*").alias("rarity"))
    a = _keys(left, lkey, rarity, least, share).withColumnsRenamed({"n": "na", "position": "pa"})
    b = _keys(right, rkey, rarity, least, share).withColumnsRenamed({"n": "nb", "position": "pb"})
    long_enough = (F.col("nb") >= F.col("na") * least) & (F.col("na") >= F.col("nb") * least)
    # shared so far at most min(pa, pb), and what follows on either side
    reach = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    near = reach >= (F.col("na") + F.col("nb")) * (least / (1 + least))
    pairs = a.join(b, "k").where(long_enough & near).select(lkey, rkey).distinct()
    full = pairs.join(left.select(lkey, F.col("members").alias("__a")), lkey).join(right.select(rkey, F.col("members").alias("__b")), rkey)
    shared = F.size(F.array_intersect("__a", "__b"))
    jaccard = shared / (F.size("__a") + F.size("__b") - shared)
    return full.withColumn("jaccard", jaccard).where(F.col("jaccard") >= least).select(lkey, rkey, "jaccard")


def correct_words(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """(word, right): typed words that aren't in the list with the listed word they come nearest to.

    Words of fewer than four letters allow no slip and are left as they are.
    """
    unknown = typed.join(listed, typed["word"] == listed["listed"], "left_anti").where(F.length("word") >= 4)
    left = cut(unknown.withColumn("members", members_udf("word")))
    right = cut(listed.where((F.length("listed") >= 4) & ~F.col("exact")).select("listed", "df").withColumn("members", members_udf("listed")))
    pairs = similar(left, right, "word", "listed", WORDS_ALIKE, WORDS_SHARE).withColumn("d", slips_udf.asNondeterministic()("word", "listed")).where("d is not null")  # not before the verification
    ranked = pairs.join(right.select("listed", "df"), "listed")
    return ranked.groupBy("word").agg(F.min_by("listed", F.struct("d", -F.col("df"), -F.col("jaccard"), "listed")).alias("right"))


def match_terms(terms: DataFrame, reference: DataFrame) -> DataFrame:
    """(term, codes): for each distinct term the codes of its best entries; terms that match none are left out."""
    al = cut(aliases(reference).withColumn("words", words_udf("alias")).where(F.size("words") > 0))
    listed = al.select(F.explode("words").alias("listed"), "exact").groupBy("listed").agg(F.min("exact").alias("exact"), F.count("*").alias("df"))
    split = cut(terms.withColumn("words", words_udf("term")).where(F.size("words") > 0))
    right = cut(correct_words(split.select(F.explode("words").alias("word")).distinct(), listed))
    each = split.select("term", F.posexplode("words").alias("at", "word")).join(right, "word", "left")
    put = each.groupBy("term").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("right", "word").alias("w")))), lambda x: x["w"])).alias("ws"))
    # terms that read alike after correction are one set, and so are aliases
    sets = cut(put.withColumn("set", F.array_join(F.array_sort("ws"), " ")))
    left = sets.select("set", F.col("ws").alias("members")).dropDuplicates(["set"])
    entries = al.withColumn("entry", F.array_join(F.array_sort("words"), " "))
    by_entry = entries.groupBy("entry").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.first("words").alias("members"))
    pairs = similar(left, by_entry.select("entry", "members"), "set", "entry", TERMS_ALIKE, TERMS_SHARE)
    lacking = F.array_except(F.array_union(F.split("set", " "), F.split("entry", " ")), F.array_intersect(F.split("set", " "), F.split("entry", " ")))
    meant = pairs.where(F.size(F.array_except(lacking, F.array(*map(F.lit, MAY_LACK)))) == 0)
    top = meant.join(by_entry.select("entry", "codes"), "entry").withColumn("best", F.max("jaccard").over(Window.partitionBy("set"))).where("jaccard = best")
    codes = top.groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
    return sets.select("term", "set").join(codes, "set").select("term", "codes")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False))


def map_candidates(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """(diagnosis_id, code) of the candidates whose raw_term is not exactly a description."""
    some = candidates.select("diagnosis_id", "raw_term", "normalized_diagnosis").where(_filled("raw_term") | _filled("normalized_diagnosis"))
    exact = reference.select(F.col("description").alias("raw_term")).where("raw_term is not null").distinct()
    open_ = some.join(exact, "raw_term", "left_anti").distinct()
    terms = open_.select(F.col("raw_term").alias("term")).unionByName(open_.select(F.col("normalized_diagnosis").alias("term"))).where("term is not null").distinct()
    found = cut(match_terms(terms, reference))
    raw = found.select(F.col("term").alias("raw_term"), F.col("codes").alias("raw_codes"))
    norm = found.select(F.col("term").alias("normalized_diagnosis"), F.col("codes").alias("norm_codes"))
    both = open_.join(raw, "raw_term", "left").join(norm, "normalized_diagnosis", "left")
    shared = F.array_intersect("raw_codes", "norm_codes")
    code = (
        F.when(F.size("raw_codes") == 1, F.col("raw_codes")[0])
        .when(F.size(shared) == 1, shared[0])
        .when(F.size("norm_codes") == 1, F.col("norm_codes")[0])
        .otherwise(UNMATCHED)
    )
    return both.select("diagnosis_id", code.alias("code")).distinct()
