"""Fields that pack several values, unpacked into one value per row (problem 5).

A field is a lattice: its possible separators (outside quotes, parentheses and JSON) are nodes, the text between two of
them is an edge. Expectation-maximisation learns, over the whole column, how often each value stands and how often each
class of separator really separates; Viterbi picks the likeliest path of every distinct field. Quoted spans and
parentheses are atomic. Edges over up to `SPAN` separators that don't separate are always there; longer ones where some
field of the column holds just such a value whole (quoted, in JSON or between other separators).

Scale: fields are reduced to their distinct texts, and taken apart once, whose result is cut; a round sends only hashes
of edges to the value frequencies, in a shuffle join, and only the edges of known values back. Neither the values nor
the fields are ever held in one place. Only the separator classes (at most fields x classes numbers) reach the driver.

Cases: a null, blank or placeholder field has no items; empty places aren't counted; repeated terms are kept. An empty
table gives an empty result. Extra columns are ignored. A field of any length is split whole.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, StringType, StructType

from noteweave.session import cut

#: The packed columns, and literals that stand for an empty field.
FIELDS = ["inclusion_terms", "exclusion_terms", "synonyms"]
PLACEHOLDERS = {"", "-", "--", "n/a", "na", "none", "null", "nil", "."}
#: Separator classes with their patterns; a comma is looked at only where none of the others stands.
CLASSES = {"line": r"\r\n|\r|\n|\t|<br\s*/?>", "semi": r"[;；]", "pipe": r"[|｜]", "ideo": r"、", "slash": r"(?<=\s)/(?=\s)", "bullet": r"[·•●▪◦‣○■]", "mark": r"(?!)", "comma": r"[,，]"}
NAMES = list(CLASSES)
#: Spans that an edge covers at most unless a longer value is known.
SPAN = 4
#: Rounds of expectation-maximisation.
ROUNDS = 2
#: Weight of an unseen value in counts, and its cost per character.
UNSEEN, PER_CHAR = 0.5, 2.0

_SEP = re.compile("|".join(f"(?P<{k}>{p})" for k, p in CLASSES.items()), re.I)
_MARK = re.compile(r"(?:\((\d{1,3})\)|(\d{1,3})[.)])(?=\s)")
_QUOTED = re.compile(r'"[^"]*(?:""[^"]*)*"')
_OPEN, _CLOSE = "([{（", ")]}）"
#: Where a quoted span, a parenthesis, a number mark or a separator may begin.
_AHEAD = re.compile("|".join([r'["(\[{（]', r"(?<!\w)\d", *(p for p in CLASSES.values())]), re.I)
_LIST_MARK = re.compile(r"[-*–—]\s+")


def _json_items(text: str) -> list[str] | None:
    if not text.startswith("["):
        return None
    try:
        got = json.loads(text)
    except ValueError:
        return None
    return [str(x) for x in got if x is not None] if isinstance(got, list) else None


def _clean(raw: str) -> str:
    s = raw.strip()
    if s and s[0] in "-*–—" and (m := _LIST_MARK.match(s)):
        s = s[m.end() :].strip()
    if len(s) > 1 and s[0] == '"' and _QUOTED.fullmatch(s):
        s = s[1:-1].replace('""', '"').strip()
    return s


def lattice(text: str | None) -> tuple[list[tuple[int, int]], list[int]]:
    """The spans between neighbouring separators (none empty) and the class of the separator after each but the last."""
    if text is None or text.strip().lower() in PLACEHOLDERS:
        return [], []
    seps, i, n, number = [], 0, len(text), 1
    while ahead := _AHEAD.search(text, i):
        i = ahead.start()
        c = text[i]
        fresh = i == 0 or text[i - 1].isspace() or bool(seps and seps[-1][1] == i)
        if fresh and (c.isdigit() or c == "(") and (m := _MARK.match(text, i)) and int(m[1] or m[2]) == number and (number > 1 or not text[:i].strip() or (seps and not text[seps[-1][1] : i].strip())):
            seps.append((i, m.end(), NAMES.index("mark")))
            number, i = number + 1, m.end()
        elif c == '"' and (m := _QUOTED.match(text, i)):
            i = m.end()
        elif c in _OPEN and (e := _closing(text, i)):
            i = e
        elif m := _SEP.match(text, i):
            if m.lastgroup != "bullet" or fresh:
                seps.append((i, m.end(), NAMES.index(m.lastgroup)))
            i = m.end()
        else:
            i += 1
    comma = NAMES.index("comma")
    if any(k != comma for _, _, k in seps):
        seps = [s for s in seps if s[2] != comma]
    spans, kinds, at = [], [], 0
    for a, b, k in [*seps, (n, n, -1)]:
        if text[at:a].strip():
            if spans:
                kinds.append(last)
            spans.append((at, a))
            last = k
        elif spans:
            last = min(last, k) if k >= 0 else last
        at = b
    return spans, kinds


def _closing(text: str, at: int) -> int:
    """Where the parenthesis at `at` closes within its line, or 0."""
    depth = 0
    for j in range(at, len(text)):
        if text[j] in _OPEN:
            depth += 1
        elif text[j] in _CLOSE:
            depth -= 1
            if not depth:
                return j + 1
        elif text[j] == "\n":
            return 0
    return 0


def edges_of(n: int, wide: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Edges (first span, span after the last), the shortest first; `wide` (first span, spans) come last."""
    return [(i, i + w) for w in range(1, min(SPAN, n) + 1) for i in range(n - w + 1)] + [(i, i + w) for i, w in wide]


def _value_hash(field: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(field + "\x1f" + " ".join(value.lower().split())) - (1 << 63)


_WIDE = StructType().add("first", LongType()).add("width", IntegerType())
_LATTICE = (
    StructType().add("a", ArrayType(IntegerType())).add("b", ArrayType(IntegerType())).add("kinds", ArrayType(ByteType())).add("h", ArrayType(LongType()))
    .add("items", ArrayType(StringType())).add("wide", ArrayType(_WIDE))
)


def _known_wide(field: str, value: str) -> tuple[int, int] | None:
    """The first span's hash and the number of spans of a value that, unquoted, would span more than SPAN of them."""
    spans, _ = lattice(value)
    return (_value_hash(field, _clean(value[slice(*spans[0])])), len(spans)) if len(spans) > SPAN else None


@pandas_udf(_LATTICE)
def take_apart(fields: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """Starts and ends of the spans, separator classes, hashes of the edges; items of fields that need no choice; wide values."""
    out = []
    for f, t in zip(fields, texts, strict=True):
        got = _json_items(t.strip())
        if got is not None:
            items = [v for v in map(str.strip, got) if v]
            wide = [w for v in items if len(_SEP.findall(v)) >= SPAN and (w := _known_wide(f, v))]
            out.append(([], [], [], [_value_hash(f, v) for v in items], items, wide))
            continue
        spans, kinds = lattice(t)
        n, wide = len(spans), []
        if len(_SEP.findall(t)) - n + 1 >= SPAN:  # else none of its values can hold so many
            wide = [w for a, b in spans if len(_SEP.findall(t, a, b)) >= SPAN and (w := _known_wide(f, _clean(t[a:b])))]
        h = [_value_hash(f, _clean(t[spans[i][0] : spans[j - 1][1]])) for i, j in edges_of(n)]
        items = [x for a, b in spans if (x := _clean(t[a:b]))] if n < 2 else None
        out.append(([a for a, _ in spans], [b for _, b in spans], kinds, h, items, wide))
    return pd.DataFrame(dict(zip(_LATTICE.names, map(list, zip(*out, strict=True)), strict=True)) if out else {k: [] for k in _LATTICE.names})


@pandas_udf(ArrayType(LongType()))
def wide_hashes(fields: pd.Series, texts: pd.Series, a: pd.Series, b: pd.Series, wide: pd.Series) -> pd.Series:
    out = []
    for f, t, x, y, w in zip(fields, texts, a, b, wide, strict=True):
        out.append([] if w is None else [_value_hash(f, _clean(t[x[e["i"]] : y[e["i"] + e["width"] - 1]])) for e in w])
    return pd.Series(out)


def viterbi(a: list[int], b: list[int], kinds: list[int], known: dict[int, float], split: list[float], total: float, wide: list[tuple[int, int]] = ()) -> tuple[list[int], list[int]]:
    """The likeliest path: the numbers of its edges (in the order of `edges_of`) and their first spans; `known` counts values by edge."""
    n = len(a)
    log_total, unseen = math.log(total), math.log(UNSEEN)
    cuts = [math.log(split[k]) for k in kinds]
    keep = [0.0]
    for k in kinds:
        keep.append(keep[-1] + math.log(1 - split[k]))
    start = [0, 0]
    for w in range(1, min(SPAN, n)):
        start.append(start[-1] + n - w + 1)
    into: dict[int, list[tuple[int, int]]] = {}
    at = start[-1] + n - min(SPAN, n) + 1
    for k, (i, w) in enumerate(wide):
        into.setdefault(i + w, []).append((i, at + k))
    best, back = [0.0] + [-math.inf] * n, [(0, 0)] * (n + 1)
    for j in range(1, n + 1):
        end, top, by = b[j - 1], -math.inf, (0, 0)
        edges = [(j - w, start[w] + j - w) for w in range(1, min(SPAN, j) + 1)]
        for i, e in edges + into.get(j, []):
            c = known.get(e, 0.0)
            s = best[i] + (math.log(c) if c > 0 else unseen - PER_CHAR * (end - a[i])) + keep[j - 1] - keep[i] - log_total
            if i:
                s += cuts[i - 1]
            if s > top:
                top, by = s, (i, e)
        best[j], back[j] = top, by
    path, firsts, j = [], [], n
    while j:
        j, e = back[j]
        path.append(e)
        firsts.append(j)
    return path[::-1], firsts[::-1]


def _path_udf(split: dict[str, list[float]], total: dict[str, float]):
    @pandas_udf(StructType().add("edges", ArrayType(IntegerType())).add("firsts", ArrayType(IntegerType())))
    def path(field: pd.Series, a: pd.Series, b: pd.Series, kinds: pd.Series, wide: pd.Series, ks: pd.Series, cs: pd.Series) -> pd.DataFrame:
        out = []
        for f, x, y, z, w, k, c in zip(field, a, b, kinds, wide, ks, cs, strict=True):
            more = [] if w is None else [(e["i"], e["width"]) for e in w]
            out.append(viterbi(x.tolist(), y.tolist(), z.tolist(), {} if k is None else dict(zip(k.tolist(), c.tolist(), strict=True)), split[f], total[f], more))
        return pd.DataFrame({"edges": [e for e, _ in out], "firsts": [i for _, i in out]})

    return path


@pandas_udf(ArrayType(StringType()))
def items_of(texts: pd.Series, a: pd.Series, b: pd.Series, wide: pd.Series, path: pd.Series) -> pd.Series:
    """The values on a path."""
    out = []
    for t, x, y, w, p in zip(texts, a, b, wide, path, strict=True):
        n, got = len(x), []
        if len(p) == n:  # every separator separates
            got = [t[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        else:
            edges = edges_of(n, [] if w is None else [(e["i"], e["width"]) for e in w])
            got = [t[x[edges[e][0]] : y[edges[e][1] - 1]] for e in p.tolist()]
        out.append([v for g in got if (v := _clean(g))])
    return pd.Series(out)


def both_catalogues(sample: DataFrame, uploads: DataFrame) -> DataFrame:
    return sample.select("row_id", *FIELDS).unionByName(uploads.select("row_id", *FIELDS))


def distinct_fields(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (row_id, field_name, fid) and distinct field texts (fid, field_name, text, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in FIELDS])).alias("c")
    cells = rows.select("row_id", each).select("row_id", "c.*").where(F.col("text").rlike(r"(?U)\S") & ~F.lower(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).isin(*PLACEHOLDERS))
    cells = cells.withColumn("fid", F.unhex(F.md5(F.concat_ws("\x1f", "field_name", "text"))))
    fields = cells.groupBy("fid").agg(F.first("field_name").alias("field_name"), F.first("text").alias("text"), F.count("*").alias("n"))
    return cells.select("row_id", "field_name", "fid"), fields


def _with_wide(lat: DataFrame) -> DataFrame:
    """Adds `more`, the edges wider than SPAN that match a known value's first span and width, and their hashes to `h`."""
    known = lat.select("field_name", F.explode("wide").alias("w")).select("field_name", "w.*").distinct()
    none = F.lit(None).cast("array<struct<i:int,width:int>>")
    if known.limit(1).count() == 0:
        return lat.withColumn("more", none)
    spans = lat.where(F.size("a") > SPAN).select("fid", "field_name", F.size("a").alias("n_spans"), F.posexplode(F.slice("h", F.lit(1), F.size("a"))).alias("i", "first"))
    more = spans.join(known, ["field_name", "first"]).where("i + width <= n_spans").groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("i", "width"))).alias("more"))
    both = lat.join(more, "fid", "left")
    return cut(both.withColumn("h", F.when(F.col("more").isNotNull(), F.concat("h", wide_hashes("field_name", "text", "a", "b", "more"))).otherwise(F.col("h"))))


def _known_edges(lat: DataFrame, counts: DataFrame) -> DataFrame:
    """(fid, ks, cs): of each field the edges whose value is known, with its count."""
    seen = lat.where(F.size("a") > 1).select("fid", F.posexplode("h").alias("k", "h")).join(counts.select("h", "c"), "h")
    lists = seen.groupBy("fid").agg(F.collect_list(F.struct("k", "c")).alias("l"))
    return lists.select("fid", F.col("l.k").alias("ks"), F.col("l.c").alias("cs"))


def learn(fields: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Expectation-maximisation over all distinct fields; the items of each (fid, field_name, n, items)."""
    lat = _with_wide(cut(fields.withColumn("e", take_apart("field_name", "text")).select("fid", "field_name", "n", F.when(F.size("e.a") > 1, F.col("text")).alias("text"), "e.*")))
    single = F.when(F.size("a") > 0, F.slice("h", F.lit(1), F.greatest(F.size("a"), F.lit(1)))).otherwise(F.col("h"))
    lattices, settled = lat.where(F.size("a") > 1), lat.where(F.size("a") <= 1)
    counts = lat.select("field_name", "n", F.explode(single).alias("h")).groupBy("field_name", "h").agg(F.sum("n").cast("double").alias("c"))
    split = {f: [0.9] * len(NAMES) for f in FIELDS}
    narrow = lattices.select("fid", "field_name", "n", "a", "b", "kinds", "more", "h")
    for k in range(rounds):
        counts = cut(counts)
        path = _path_udf(split, _totals(counts)).asNondeterministic()("field_name", "a", "b", "kinds", "more", "ks", "cs")  # evaluated once
        if k == rounds - 1:
            break
        got = narrow.join(_known_edges(lat, counts), "fid", "left").select("field_name", "n", "kinds", "h", path.alias("path"))
        used = cut(got.select("field_name", "n", "kinds", F.transform("path.edges", lambda e: F.get("h", e)).alias("hs"), F.col("path.firsts").alias("firsts")))
        parted = used.select("field_name", "n", "firsts", F.posexplode("kinds").alias("k", "kind")).withColumn("cuts", F.array_contains("firsts", F.col("k") + 1))
        stats = parted.groupBy("field_name", "kind").agg(F.sum(F.when(F.col("cuts"), F.col("n")).otherwise(0)).alias("cut"), F.sum("n").alias("all"))
        for r in stats.collect():  # at most fields x classes rows
            split[r["field_name"]][r["kind"]] = (r["cut"] + 9) / (r["all"] + 10)
        every = used.select("field_name", "n", F.explode("hs").alias("h")).unionByName(settled.select("field_name", "n", F.explode(single).alias("h")))
        counts = every.groupBy("field_name", "h").agg(F.sum("n").cast("double").alias("c"))
    chosen = lattices.drop("h", "items", "wide").join(_known_edges(lat, counts), "fid", "left").withColumn("path", path)
    return chosen.select("fid", "field_name", "n", items_of("text", "a", "b", "more", "path.edges").alias("items")).unionByName(settled.select("fid", "field_name", "n", "items"))


def _totals(counts: DataFrame) -> dict[str, float]:
    got = {r["field_name"]: r["t"] for r in counts.groupBy("field_name").agg(F.sum("c").alias("t")).collect()}  # one row a field
    return {f: max(1.0, got.get(f) or 1.0) for f in FIELDS}


def unpack(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per term: row_id, field_name, item_no from 1, item, and n_items of the field."""
    cells, fields = distinct_fields(rows)
    items = learn(fields, rounds).select("fid", "items", F.size("items").alias("n_items"))
    out = cells.join(items, "fid").select("row_id", "field_name", "n_items", F.posexplode("items").alias("p", "item"))
    return out.select("row_id", "field_name", (F.col("p") + 1).alias("item_no"), "item", "n_items")
