"""Column expressions over codes and text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.functions import values as V

_TRIM = r"(?U)^\s+|\s+$"
#: Characters with their plain forms, and characters that are dropped.
PLAIN_FROM, PLAIN_TO = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0\u2009", "''\"\"--  "
DROPPED = "[\u200b\ufeff\r]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in d.items() for x in kv])


# ---- codes


def unformat_code(c: Column) -> Column:
    """Letters and digits only, in upper case."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def format_code(c: Column) -> Column:
    """Procedure and morphology codes as they are, dotted ones in upper case, others with a dot after three places."""
    t = trim(c)
    clean = unformat_code(t)
    dotted = F.when((F.length(clean) > 3) & clean.rlike("^[A-Z][0-9]"), F.concat(clean.substr(1, 3), F.lit("."), clean.substr(F.lit(4), F.length(clean)))).otherwise(clean)
    return F.when(t == "", "").when(t.rlike(r"^\d+$"), t).when(t.rlike(r"^\d{4}[A-Za-z]$") | t.rlike(r"(?i)^M[89]\d{3}[./]\d$"), F.upper(t)).when(t.contains("."), F.upper(t)).otherwise(dotted)


def valid_code(c: Column) -> Column:
    u = unformat_code(c)
    return F.length(u).between(3, 7) & u.rlike("^[A-Z][0-9][0-9A-Z]{1,5}$")


# ---- fields


def parse_list(c: Column) -> Column:
    """A JSON array, else split at semicolons, else at bars, else one value; blanks left out."""
    t = trim(c)
    parts = F.when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array(t))).when(t.contains(";"), F.split(t, ";")).when(t.contains("|"), F.split(t, r"\|")).otherwise(F.array(t))
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def parse_flag(c: Column, default: bool | None = None) -> Column:
    t = F.lower(trim(c))
    return F.when(t.isin("1", "true", "yes", "y", "t", "billable"), True).when(t.isin("0", "false", "no", "n", "f", "header", "non-billable"), False).otherwise(F.lit(default).cast("boolean"))


# ---- words


def tokens(c: Column, pattern: str = "[A-Za-z0-9_]+") -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def expand_abbreviations(c: Column) -> Column:
    """Words joined by blanks, abbreviations written out; punctuation is lost."""
    m = literal_map(V.ABBREVIATIONS)
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(m, F.lower(t)), t)), " ")


def clinical_tokens(c: Column) -> Column:
    """Lower-case tokens after expansion, without stop words; one letter only if it tells something."""
    stop = F.array(*map(F.lit, V.STOP_WORDS))
    all_ = tokens(F.lower(expand_abbreviations(c)), "[a-z0-9]+")
    return F.filter(all_, lambda t: ~F.array_contains(stop, t) & ((F.length(t) > 1) | t.rlike("^[0-9bcdkt]$")))


def related_tokens(ts: Column) -> Column:
    """Tokens with their related words and singulars, each once, in order."""
    m = literal_map(V.RELATED_WORDS)
    singular = lambda t: F.when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 4), F.array(t.substr(F.lit(1), F.length(t) - 1))).otherwise(F.array().cast("array<string>"))
    more = F.flatten(F.transform(ts, lambda t: F.concat(F.coalesce(F.try_element_at(m, t), F.array().cast("array<string>")), singular(t))))
    return F.array_distinct(F.concat(ts, more))


def normalize_document(c: Column) -> Column:
    """Plain quotes, dashes and blanks; words hyphenated at line ends joined; lines trimmed; at most two breaks in a row."""
    s = F.translate(c, PLAIN_FROM, PLAIN_TO)
    s = F.regexp_replace(s, DROPPED, "")
    s = F.regexp_replace(s, r"([a-zA-Z]{3,})-[ \t]*\n[ \t]*([a-zA-Z]{3,})", "$1$2")
    s = F.regexp_replace(s, r"[ \t]+", " ")
    s = F.regexp_replace(s, r" ?\n ?", "\n")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^[ \n]+|[ \n]+$", "")


def has_cue(c: Column, cues: list[str]) -> Column:
    return F.coalesce(F.lower(c).rlike(r"(^|[^a-z0-9])(" + "|".join(cues) + r")([^a-z0-9]|$)"), F.lit(False))


def polarity(c: Column) -> Column:
    """Negation first, then uncertainty (a question mark counts)."""
    return F.when(has_cue(c, V.NEGATION), "NEGATED").when(has_cue(c, V.UNCERTAINTY) | F.coalesce(c.contains("?"), F.lit(False)), "UNCERTAIN").otherwise("AFFIRMED")


def acuity(c: Column) -> Column:
    a, k = has_cue(c, V.ACUTE), has_cue(c, V.CHRONIC)
    return F.when(a & k, "ACUTE_ON_CHRONIC").when(a, "ACUTE").when(k, "CHRONIC").otherwise("UNSPECIFIED")


def laterality(c: Column) -> Column:
    return F.when(has_cue(c, ["bilateral", "both"]), "BILATERAL").when(has_cue(c, ["right", "rt"]), "RIGHT").when(has_cue(c, ["left", "lt"]), "LEFT").otherwise("NONE")


def verbatim_start(text: Column, quote: Column) -> Column:
    """Where a quote stands in a text, from 0: as it is, else in any case; null if it doesn't."""
    exact, loose = F.position(quote, text), F.position(F.lower(quote), F.lower(text))
    return F.when(exact > 0, exact - 1).when(loose > 0, loose - 1)
