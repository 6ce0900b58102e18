"""Text that was decoded with the wrong character encoding, found and restored (problem 3).

The units of a text are its words (runs of letters and of anything beyond ASCII) and its runs beyond ASCII. Of every
distinct clean unit the garbled forms under all encoding chains are generated; the units of the documents are joined
with this table by hash, and those that match are replaced by the verified original. The table decides wherever it
reaches. Beyond its reach are units whose original stands nowhere clean (spaceless scripts join sentences into ever new
units): these are taken letter by letter, if they are wholly a row of garbled letters of the corpus under one chain. What
can't be restored (replacement characters, stray control characters) is reported as such. `routes` counts each way.

A match is evidence by itself if its unit is no likely word (`sure`); others count where a text holds `SEVERAL` of them
under one chain.

Scale: texts are read once, into their tokens beyond ASCII, cut from their lineage; everything else works on distinct
tokens and units, and the garbled ones meet the documents' tokens in a shuffle join, which adaptive execution may
broadcast or split by size. Only the set of clean letters (bounded by Unicode) reaches the driver.

Cases: null, empty and ASCII texts are clean; a soft sign of hyphenation at a line end ('¬') is clean; rows that stand
twice are both found; a text of any length is read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from noteweave.session import cut

#: Encodings a UTF-8 text may have been read as.
WRONG = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1253", "cp1254", "iso8859_2", "iso8859_15", "koi8_r", "cp866", "cp874", "cp1256"]
#: Encodings a text may have been written in before it was read as Windows or ISO Latin.
OTHER = ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1253", "iso8859_7", "cp1250", "iso8859_2", "cp1254", "mac_roman", "cp437", "cp850", "cp932", "euc_jp", "gbk", "big5", "euc_kr", "cp874", "cp1256", "cp1255"]
MULTI = {"cp932", "euc_jp", "gbk", "big5", "euc_kr"}
#: Chains as steps (written in, read as); the last kind loses letters: bytes of Windows Latin read as UTF-8.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    *[(("utf-8", w),) for w in WRONG],
    *[(("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")],
    *[((t, "cp1252"),) for t in OTHER],
    *[((t, "latin-1"),) for t in OTHER if t in MULTI or t in ("cp1251", "koi8_r", "cp866", "cp1253")],
    *[((t, "cp1251"),) for t in ("koi8_r", "cp866", "cp1252")],
    *[((t, "koi8_r"),) for t in ("cp1251", "cp866")],
    (("cp1252", "lossy"),),
    (("cp1251", "lossy"),),
]
#: Letters in a row of a two-byte encoding that are sure; unsure matches of one chain, and their least length, that make a
#: text a case.
SURE, SEVERAL, TELLING = 2, 3, 4

_HIGH = r"\x{80}-\x{10FFFF}"
#: A token with a character beyond ASCII, and the blanks after it.
TOKEN = rf"((?<![^\x{{00}}-\x{{20}}])[\x{{21}}-\x{{7F}}]*+[{_HIGH}][^\x{{00}}-\x{{20}}]*+[ \t\r]*+\n?)"
UNIT = rf"(?<![A-Za-z{_HIGH}])[A-Za-z]*+[{_HIGH}][A-Za-z{_HIGH}]*+"
RUN = rf"[{_HIGH}]++"
#: Units of legacy two-byte encodings also hold ASCII bytes: whole tokens with a letter that such bytes are often read as.
_MARKS = r"[\x{80}-\x{9F}\x{152}\x{160}\x{192}\x{201A}-\x{2039}]"
_PY_HIGH = "\x80-\U0010ffff"
_PY_UNIT = re.compile(f"(?<![A-Za-z{_PY_HIGH}])[A-Za-z]*[{_PY_HIGH}][A-Za-z{_PY_HIGH}]*")
_PY_RUN = re.compile(f"[{_PY_HIGH}]+")
_PY_TOKEN = re.compile(f"[\x21-\x7f]*[{_PY_HIGH}][^\x00-\x20]*")

_READ: dict[str, list[str]] = {}
_BYTE: dict[str, dict[str, int]] = {}


def _table(enc: str) -> list[str]:
    """What each byte is read as; undefined bytes as control characters."""
    if enc not in _READ:
        out = []
        for b in range(256):
            try:
                out.append(bytes([b]).decode(enc))
            except UnicodeDecodeError:
                out.append(chr(b))
        _READ[enc] = out
        _BYTE[enc] = {c: b for b, c in reversed(list(enumerate(out)))}
    return _READ[enc]


def garble(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The word as the chain makes it; None if it can't be written so or comes out the same."""
    s = word
    for written, read in chain:
        try:
            raw = s.encode(written)
        except UnicodeEncodeError:
            return None
        if read == "lossy":
            s = raw.decode("utf-8", "replace")
            if "�" not in s:
                return None
        else:
            t = _table(read)
            s = "".join([t[b] for b in raw])
    return s if s != word else None


def restore(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The chain undone, if every byte allows it."""
    s = word
    for written, read in reversed(chain):
        if read == "lossy":
            return None
        _table(read)
        back = _BYTE[read]
        try:
            s = bytes([back[c] if c in back else ord(c) for c in s]).decode(written)
        except (UnicodeDecodeError, ValueError):
            return None
    return s if s != word else None


def _ends(chain: tuple[tuple[str, str], ...]) -> tuple[frozenset, frozenset]:
    """What lead bytes and what continuation bytes of UTF-8 are read as by the last step of a chain."""
    t = _table(chain[-1][1])
    return frozenset(t[0xC2:0xF5]), frozenset(t[0x80:0xC0])


_FIRST = re.compile(r"[^\x00-\x7f]+")
_UTF8 = [c for c in CHAINS if c[0][0] == "utf-8"]
_DOUBLE = [c for c in _UTF8 if len(c) > 1]
_TRIED = [(c, CHAINS.index(c), *_ends(c)) for c in (*_DOUBLE, *[c for c in _UTF8 if len(c) == 1])]
_TWO_BYTE = [c for c in CHAINS if c[0][0] in MULTI]


def _beyond(s: str) -> str:
    return "".join([c for c in s if c > "\x7f"])


def _plain(s: str) -> bool:
    """Whether a text has no control, private, unassigned or replacement character."""
    return all(unicodedata.category(c) not in ("Cc", "Co", "Cn", "Cs") and c != "�" for c in s)


def as_letters(unit: str, letters: frozenset | None) -> tuple[str, int] | None:
    """The unit as a row of garbled letters under one chain: (original, chain number). `letters`: the clean ones."""
    first = _FIRST.search(unit)
    if first is None or len(first[0]) < 2:
        return None
    lead, then = first[0][:2]
    for chain, k, leads, thens in _TRIED:
        if lead in leads and then in thens:
            o = restore(unit, chain)
            if o is not None and _plain(o) and (b := _beyond(o)) and (letters is None or all(c in letters for c in b)):
                return o, k
    return None


def as_two_bytes(token: str, letters: frozenset) -> tuple[str, int] | None:
    """A token as a row of letters of a two-byte encoding."""
    best = None
    for chain in _TWO_BYTE:
        o = restore(token, chain)
        if o is not None and _plain(o) and len(b := _beyond(o)) >= SURE and 2 * len(b) >= len(o) and all(c in letters for c in b) and any("぀" <= c <= "鿿" or "가" <= c <= "힣" for c in b):
            if best is None or len(b) > best[2]:
                best = (o, CHAINS.index(chain), len(b))
    return best[:2] if best else None


def _script(s: str) -> str:
    """The script of the first letter beyond ASCII, by the name of the character."""
    for c in s:
        if c > "\x7f" and c.isalpha():
            return unicodedata.name(c, "?").split(" ")[0]
    return ""


def sure(unit: str, original: str) -> bool:
    """Whether a match in the table is evidence by itself: the unit as it stands is no likely word of its script."""
    if "�" in unit or not _plain(unit):
        return True
    b = _beyond(unit)
    if _script(original) not in ("LATIN", "") and len(b) >= 4:
        return True
    return len(b) >= 3 and len(unit) >= 5


def likely(unit: str) -> bool:
    """Whether a unit may be a word as it stands: letters of one script in usual case, Latin ones mostly without marks."""
    letters = [c for c in unit if c.isalpha()]
    if not letters or not _plain(unit) or len(letters) + sum(unicodedata.combining(c) > 0 for c in unit) < len(unit):
        return False
    scripts = {unicodedata.name(c, "?").split(" ")[0] for c in letters}
    if len(scripts) > 1:
        return scripts <= {"CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA"}
    usual = unit.islower() or unit.isupper() or unit[1:].islower() or not any(c.isupper() or c.islower() for c in unit)
    return usual and ("LATIN" not in scripts or 2 * len(_beyond(unit)) <= len(letters))


_FORMS = ArrayType(StructType().add("form", StringType()).add("chain", IntegerType()))


@pandas_udf(_FORMS)
def forms(units: pd.Series) -> pd.Series:
    out = []
    for u in units:
        seen: dict[str, int] = {}
        for k, chain in enumerate(CHAINS):
            g = garble(u, chain)
            if g is not None and g not in seen:
                seen[g] = k
        out.append(list(seen.items()))
    return pd.Series(out)


@pandas_udf(BooleanType())
def is_clean(units: pd.Series) -> pd.Series:
    return pd.Series([_plain(u) and as_letters(u, None) is None for u in units])


def _letter_udf(letters: frozenset, two_bytes: bool):
    @pandas_udf(StructType().add("original", StringType()).add("chain", IntegerType()))
    def parse(units: pd.Series) -> pd.DataFrame:
        got = [(as_two_bytes(u, letters) if two_bytes else as_letters(u, letters)) or (None, -1) for u in units]
        return pd.DataFrame({"original": pd.Series([x[0] for x in got], dtype=object), "chain": pd.Series([x[1] for x in got], dtype="int32")})

    return parse


@pandas_udf(BooleanType())
def _turned(units: pd.Series, originals: pd.Series) -> pd.Series:
    """Whether the original is the likely one of the two; by frequency alone, a form that stands as often would be kept."""
    return pd.Series([likely(o) and not likely(u) for u, o in zip(units, originals, strict=True)])


@pandas_udf(BooleanType())
def _sure(units: pd.Series, originals: pd.Series) -> pd.Series:
    return pd.Series([sure(u, o) for u, o in zip(units, originals, strict=True)])


def document_tokens(docs: DataFrame) -> DataFrame:
    """(id, token): the distinct tokens beyond ASCII of each text, with the blanks after them; cut from their lineage."""
    some = docs.where(F.col("text").rlike(f"[{_HIGH}]"))
    return cut(some.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)))).alias("token")))


def token_units(tokens: DataFrame) -> DataFrame:
    """(token, n, unit, whole): the units of each distinct token (n texts hold it); whole marks tokens that may be of two-byte encodings.

    The sign of hyphenation at a line end is no part of a unit.
    """
    each = tokens.groupBy("token").agg(F.count("*").alias("n"))
    t = F.regexp_replace("token", r"\x{AC}[ \t\r]*\n?$", "-")
    bare = F.regexp_replace("token", r"[ \t\r\n]+$", "")
    inside = F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(f"({UNIT})"), F.lit(1)), F.regexp_extract_all(t, F.lit(f"({RUN})"), F.lit(1))))
    units = F.transform(inside, lambda u: F.struct(u.alias("unit"), F.lit(False).alias("whole")))
    whole = F.when(bare.rlike(_MARKS), F.array(F.struct(bare.alias("unit"), F.lit(True).alias("whole")))).otherwise(F.array().cast("array<struct<unit:string,whole:boolean>>"))
    return cut(each.select("token", "n", F.explode(F.concat(units, whole)).alias("u")).select("token", "n", "u.*"))


#: Ways to an original, the first that applies.
ROUTES = ["table", "letters", "lost"]


def garbled_units(spark: SparkSession, units: DataFrame) -> DataFrame:
    """The garbled ones among the units: unit, whole, original (null if lost), chain, sure, route."""
    counts = cut(units.groupBy("unit", "whole").agg(F.sum("n").alias("n")))
    words = counts.where("not whole").select("unit", "n")
    clean = words.withColumn("clean", is_clean("unit")).where("clean").select("unit", "n")
    letters = frozenset(r["c"] for r in clean.select(F.explode(F.array_distinct(F.split("unit", ""))).alias("c")).where("c > '\x7f'").distinct().collect())  # bounded by Unicode
    made = clean.withColumn("f", F.explode(forms("unit"))).select(F.col("f.form").alias("unit"), F.col("unit").alias("original"), "f.chain", F.col("n").alias("n_original"))
    met = words.join(made, "unit").withColumn("turned", _turned("unit", "original")).where("turned or n_original > n").withColumn("sure", _sure("unit", "original"))
    matched = met.groupBy("unit").agg(F.max_by(F.struct("original", "chain", "sure"), F.struct("sure", "n_original", "original")).alias("m")).select("unit", "m.*")
    rest = words.join(matched.where("sure").select("unit"), "unit", "left_anti")
    by_letter = rest.withColumn("m", _letter_udf(letters, False)("unit")).where("m.original is not null").select("unit", "m.*", F.lit(True).alias("sure"))
    lost = rest.where(F.col("unit").rlike(r"[\x{FFFD}\x{80}-\x{84}\x{86}-\x{9F}]")).select("unit", F.lit(None).cast("string").alias("original"), F.lit(-1).alias("chain"), F.lit(True).alias("sure"))
    ways = [x.withColumn("rank", F.lit(k)) for k, x in enumerate((matched, by_letter, lost))]
    best = ways[0].unionByName(ways[1]).unionByName(ways[2])
    best = best.groupBy("unit").agg(F.min_by(F.struct("original", "chain", "rank"), F.struct(~F.col("sure"), "rank", "chain")).alias("b"), F.max("sure").alias("sure")).select("unit", F.lit(False).alias("whole"), "b.*", "sure")
    two = counts.where("whole").withColumn("m", _letter_udf(letters, True)("unit")).where("m.original is not null").select("unit", "whole", "m.*", F.lit(1).alias("rank"), F.lit(True).alias("sure"))
    names = F.array(*map(F.lit, ROUTES))
    return cut(best.unionByName(two).withColumn("route", F.get(names, F.col("rank"))).drop("rank"))


def garbled_in(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(id, unit, whole, original, chain, sure, route) of every case: a sure garbled unit, or several of one chain."""
    tokens = document_tokens(docs)
    units = token_units(tokens)
    garbled = garbled_units(spark, units)
    hits = tokens.join(units.drop("n").join(garbled, ["unit", "whole"]), "token").drop("token").distinct()
    per_chain = hits.groupBy("id", "chain").agg(F.max("sure").alias("sure"), F.count_if(F.length("unit") >= TELLING).alias("k")).where(f"sure or k >= {SEVERAL}")
    chains = per_chain.groupBy("id").agg(F.collect_set("chain").alias("chains"))
    return hits.join(chains, "id").where("sure or array_contains(chains, chain)").drop("chains")


def found(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return garbled_in(spark, docs).select("id").distinct()


def routes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(route, n_units, n_texts): how many distinct units came by each way, and in how many texts it was used."""
    return garbled_in(spark, docs).groupBy("route").agg(F.countDistinct("unit").alias("n_units"), F.countDistinct("id").alias("n_texts"))


def _replace(text: str, pairs: list) -> str:
    """Each garbled unit by its original, where it stands as a unit: whole tokens, then words, then runs."""
    whole = {p["unit"]: p["original"] for p in pairs if p["whole"] and p["original"] is not None}
    table = {p["unit"]: p["original"] for p in pairs if not p["whole"] and p["original"] is not None}
    run = lambda m: table.get(m[0], m[0])
    unit = lambda m: table[m[0]] if m[0] in table else _PY_RUN.sub(run, m[0])
    token = lambda m: whole[m[0]] if m[0] in whole else _PY_UNIT.sub(unit, m[0])
    return _PY_TOKEN.sub(token, text)


def restored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Affected texts: id, n_units, n_lost and the text with its original letters where they can be recovered."""
    hits = garbled_in(spark, docs)
    by_id = hits.groupBy("id").agg(F.collect_list(F.struct("unit", "whole", "original")).alias("pairs"), F.count("*").alias("n_units"), F.count_if(F.col("original").isNull()).alias("n_lost"))

    @pandas_udf(StringType())
    def put_back(texts: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([_replace(t, p) for t, p in zip(texts, pairs, strict=True)])

    return docs.select("id", "text").join(by_id, "id").select("id", "n_units", "n_lost", put_back("text", "pairs").alias("text"))
