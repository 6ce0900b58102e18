"""Sentence units across languages and scripts (problem 10).

A hidden-event n-gram model: between a word that ends in a terminator and the next word, and at a gap inside a script
that writes no full stop, a boundary event may hide. Known events (ends and starts of blocks) and
expectation-maximisation over the whole corpus give the chance of an event after each word and of each word at the start
of a unit; posteriors come from a forward-backward pass whose state is the number of words since the last boundary. Rare
words fall back to their shape. A gap in Thai has one chance for the whole corpus, learnt from the prior `GAP`, since
TESTDATA.md fixes that such a gap ends the unit. The model's n-grams are hashed into tables of a fixed size (`BUCKETS`), so
what is collected and broadcast never grows with the corpus, while every text is counted.

Before that, structure is certain: blank lines, headings, list items and free-standing lines end units; a line break is
a mere wrap if the next word would not have fitted into the line; nothing ends inside quotes or parentheses, however long,
that close before another one of their kind opens.

Scale: each text is read twice, for its width and into its possible boundaries; these are kept as hashes and offsets, cut
from their lineage, and learning and the final decision see nothing else. Expectations are summed in numpy.

Cases: null, empty and blank texts have no units; texts are read whole; texts that stand twice give units twice; an
empty table gives an empty result. Offsets count characters of the text as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, StructType

from noteweave.session import cut

#: Slots of the hashed n-gram tables; rounds of expectation-maximisation; weight of the fallback to shapes, in counts.
BUCKETS, ROUNDS, BACK_OFF = 1 << 18, 4, 2.0
#: Prior chance of an event at a gap of a script without full stops, and its weight in counts.
GAP, GAP_WEIGHT = 0.95, 10.0
#: States of the forward-backward pass: words since the last boundary, the last state for this many or more.
STATES = 6
#: Widths of wrapped texts lie in this range.
NARROWEST, WIDEST = 50, 100

_END = re.compile(
    r"(?:[.!?…؟।]+|(?<=[Ͱ-Ͽἀ-῿])[;·;])[\"”“»’)\]}]*(?:[   ]?»)?(?=\s|$)"  # with a gap after it
    r"|(?<=[^\W\d_][^\W\d_])[.!?][\"”»]?(?=[“„«]?[A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ][^\W\d_]*(?:[.,;:'’-]|\s|$))"  # the gap is missing
    r"|[。！？｡．]+[”」』）〉》\"’]*"  # without one
    r"|(?<=[぀-ヿ一-鿿])…+[”」』）]*"
)
_MARK = re.compile(r"\s*(?:[-*•·●▪◦‣–—]|\(?(\d{1,3})[.)])\s+(?=\S)")
_WORD = re.compile(r"\S+")
_STOP = re.compile(r"[.!?…؟।;·;。！？｡．]")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "‘": "’"}
_QUOTES = re.compile("[" + re.escape("".join(dict.fromkeys("".join(_PAIRS) + "".join(_PAIRS.values())))) + '"]')
_THAI = "ก-๛"
_GAP = re.compile(rf"(?<=[{_THAI}])[^\S\n]+(?=[{_THAI}])|(?<=[{_THAI}])\s+(?=[{_THAI}])")
_THAI_LETTER = re.compile(f"[{_THAI}]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def _masked(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Spans inside quotes and parentheses of text[lo:hi], from the opening to just before the closing mark, in order.

    A mark is open only if it closes before another one of its kind opens; spans inside others are left out.
    """
    marks = [(m.start(), m[0]) for m in _QUOTES.finditer(text, lo, hi)]
    out, k = [], 0
    while k < len(marks):
        at, c = marks[k]
        k += 1
        if c == '"':
            if not ((at == lo or text[at - 1].isspace() or text[at - 1] in "([:—") and at + 1 < hi and not text[at + 1].isspace()):
                continue
            close = '"'
        elif c in _PAIRS and not (c == "‘" and at > lo and text[at - 1].isalnum()):
            close = _PAIRS[c]
        else:
            continue
        for j in range(k, len(marks)):
            if marks[j][1] in close:
                if c != '"' or marks[j][0] + 1 >= hi or not text[marks[j][0] - 1].isspace():  # else it opens another one
                    out.append((at, marks[j][0]))
                    k = j + (c != '"' and marks[j][1] not in _PAIRS) + (c == '"')
                break
            if marks[j][1] == c:
                break
    return out


_DIGITS = re.compile(r"\d+")


def _squash(word: str) -> str:
    return _DIGITS.sub("0", word)


def _shape(word: str) -> str:
    """Terminator, length and letters of a word that ends in a terminator."""
    word = word.rsplit(" ", 1)[-1] if word.rsplit(" ", 1)[-1].strip(".!?…؟।;·»”\"") else word
    m = re.search(r"[.!?…؟।。！？;·]+", word)
    end = m[0][:1] + ("+" if m and len(m[0]) > 1 else "") if m else "?"
    core = re.sub(r"\W+", "", word)
    kind = "0" if core[:1].isdigit() else "A" if core[:1].isupper() else "a"
    return f"{end}{kind}{min(len(core), 3)}{'.' if '.' in word.rstrip('.”»)\"') and kind != '0' else ''}{'q' if word[-1:] in '”»\"」』“' else ''}"


def _next_shape(word: str) -> str:
    c = word[:1]
    return "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "c" if _CJK.match(c) else "o" if c.isalpha() else "p"


def _hash(part: str, word: str) -> int:
    return xxhash.xxh3_64_intdigest(part + "\x1f" + word) >> 12  # exact as a float, too


def _shape_code(shape: str, strong: bool = False) -> int:
    """A shape as a number, above 0 if its terminator is a strong one."""
    code = xxhash.xxh32_intdigest(shape) & 0x3FFFFFFF or 1
    return code if strong else -code


#: The code of a gap in a script without full stops.
GAP_CODE = _shape_code("gap")
_CODES: dict[str, tuple[int, int]] = {}


def _before_codes(word: str) -> tuple[int, int]:
    """Hash and shape of the word before a possible boundary."""
    got = _CODES.get(word)
    if got is None:
        shape = _shape(word)
        if len(_CODES) > 200_000:
            _CODES.clear()
        got = _CODES[word] = (_hash("b", word), _shape_code(shape, shape[:1] in "!?…؟।。！？"))
    return got


def _after_codes(word: str) -> tuple[int, int]:
    return _hash("s", word), _shape_code(_next_shape(word))


def _after(text: str, at: int, hi: int) -> str:
    """The word from `at` on, without its digits and end marks; of scripts without gaps two letters."""
    w = _WORD.match(text, at, hi)
    if w is None:
        return ""
    w = w[0]
    if not w.isascii() and _CJK.search(w):
        return w[:2]
    if w.isalpha():
        return w
    return _squash(_INNER.split(w, maxsplit=1)[0].rstrip(".,;:!?"))


_INNER = re.compile(r"(?<=[^\W\d_][^\W\d_])[.!?]")
_LETTER = re.compile(r"[^\W\d_]")


def candidates(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int, str, str, int]], str | None]:
    """(end, start of the next, word before, word after, words since the last) at each possible boundary of text[lo:hi], and
    the word before a terminator at its very end. The words are empty at a gap of a script without full stops."""
    out, last, end = [], lo, None
    masks = _masked(text, lo, hi)
    k = past = 0
    for stop in _STOP.finditer(text, lo, hi):
        a = stop.start()
        if a < past or not (m := _END.match(text, a, hi)):
            continue
        e = past = m.end()
        while k < len(masks) and masks[k][1] < a:
            k += 1
        if k < len(masks) and masks[k][0] < a and e <= masks[k][1]:
            continue
        n = e
        while n < hi and text[n].isspace():
            n += 1
        b = a
        if n == e and n < hi or _CJK.match(text[a - 1 : a] or " "):
            b = max(lo, a - 3)
            words = max(1, (e - last) // 2)
        else:
            if a > lo and text[a - 1].isspace():
                while b > lo and text[b - 1].isspace():
                    b -= 1
            while b > max(lo, last) and not text[b - 1].isspace():
                b -= 1
            if len(_LETTER.findall(text, b, e)) <= 2:  # a number or an initial: with the word before it
                while b > lo and text[b - 1].isspace():
                    b -= 1
                while b > lo and not text[b - 1].isspace():
                    b -= 1
            words = len(text[last:e].split())
        before = _squash(" ".join(text[b:e].split()))
        if n >= hi:
            end = before
            break
        out.append((e, n, before, _after(text, n, hi), words))
        last = n
    if _THAI_LETTER.search(text, lo, hi):
        gaps = [m.span() for m in _GAP.finditer(text, lo, hi) if not any(s < m.start() < f for s, f in masks)]
        if gaps:
            out = sorted([*out, *((a, b, "", "", 0) for a, b in gaps)])
            at = lo
            for i, (a, b, before, after, _) in enumerate(out):
                out[i] = (a, b, before, after, max(1, len(text[at:a].split()), (a - at) // 5))
                at = b
    return out, end


def _lines(text: str) -> list[tuple[int, int]]:
    """Start and end of each line without its blanks; empty lines have start = end."""
    out = []
    for m in re.finditer(r"[^\n  \x0b\x0c]*(?:[\n  \x0b\x0c]|$)", text):
        a, b = m.span()
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        out.append((a, b))
    return out


def width(text: str) -> int:
    """The longest line that could have been wrapped, from its indentation on; 0 where there is none."""
    most = 0
    for a, b in _lines(text):
        if b - a > most and any(c.isspace() for c in text[a:b]):
            most = b - a
    return most


def _listed(text: str, m: re.Match, number: int, item: re.Match | None, before: tuple[int, int]) -> bool:
    """Whether a line that may be the rest of a wrapped one begins with a list mark all the same."""
    ended = any(e.end() == before[1] for e in _END.finditer(text, max(before[0], before[1] - 8), before[1]))
    if m[1]:
        return int(m[1]) == number + 1 and (number > 0 or ended)
    mark = m[0].strip()
    return mark in "*•·●▪◦‣" or ended or bool(item and item[0].strip() == mark)


def blocks(text: str, widths: tuple[int, ...]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans that are units by structure (headings, list items), and spans of running text to be divided."""
    lines = _lines(text)
    longest = width(text)
    fit = min([w for w in widths if longest <= w], default=0)
    if not widths and NARROWEST <= longest <= WIDEST:
        fit = longest
    whole, running = [], []
    group: list[tuple[int, int]] = []

    def close(g: list[tuple[int, int]]) -> None:
        if not g:
            return
        wraps = fit and any(_END.search(text, a, b) or _GAP.search(text, a, b) for a, b in g)
        start, item, number = g[0][0], None, 0
        for k, (a, b) in enumerate(g):
            wrapped = False
            if k:
                first = _WORD.match(text, a)
                spaceless = bool(_CJK.search(first[0]))
                need = 1 if spaceless else 1 + len(first[0])
                wrapped = bool(wraps) and (g[k - 1][1] - g[k - 1][0]) + need > fit
            m = _MARK.match(text, a, b)
            is_item = bool(m) and (not wrapped or _listed(text, m, number, item, g[k - 1]))
            if k and (is_item or not wrapped):
                (whole if item else running).append((start, g[k - 1][1]))
                start, item = a, None
            if is_item:
                item = m
                number = int(m[1]) if m[1] else 0
        (whole if item else running).append((start, g[-1][1]))

    for a, b in lines:
        if a == b:
            close(group)
            group = []
        else:
            group.append((a, b))
    close(group)
    return whole, running


#: What of a text the model sees. `whole` and `running`: spans, flat; per possible boundary its end, the next start, hashes
#: and shapes before and after, words since the last; `size`: how many in each running span; `tail`: known ends and starts.
_PARTS = (
    StructType().add("whole", ArrayType(IntegerType())).add("running", ArrayType(IntegerType())).add("size", ArrayType(IntegerType()))
    .add("e", ArrayType(IntegerType())).add("n", ArrayType(IntegerType())).add("kb", ArrayType(LongType())).add("sb", ArrayType(IntegerType())).add("ka", ArrayType(LongType())).add("sa", ArrayType(IntegerType())).add("words", ArrayType(ByteType()))
    .add("tail", ArrayType(StructType().add("kb", LongType()).add("sb", IntegerType()).add("ka", LongType()).add("sa", IntegerType())))
)


def parts(text: str, widths: tuple[int, ...]) -> tuple[list, ...]:
    """The row of `_PARTS` of a text."""
    whole, running = blocks(text, widths)
    size, e, n, kb, sb, ka, sa, words, tail = [], [], [], [], [], [], [], [], []
    for lo, hi in running:
        cands, end = candidates(text, lo, hi)
        size.append(len(cands))
        for at, then, before, after, k in cands:
            h, c = _before_codes(before) if before else (0, GAP_CODE)
            g, d = _after_codes(after) if after else (0, GAP_CODE)
            e.append(at), n.append(then), kb.append(h), sb.append(c), ka.append(g), sa.append(d), words.append(min(k, STATES))
        if end is not None:
            tail.append((*_before_codes(end), *_after_codes(_after(text, lo, hi))))
    return [x for ab in whole for x in ab], [x for ab in running for x in ab], size, e, n, kb, sb, ka, sa, words, tail


class Model:
    """Hashed n-gram tables with fallbacks to shapes.

    `total`, `end` and `event` count, by the word before: all sightings, known ends, and expected events. `yes` and `no`
    count, by the word after: known starts and expected non-events. The same by shape. `gap`: the chance at a gap.
    """

    def __init__(self):
        self.table = {k: np.zeros(BUCKETS, dtype=np.float32) for k in KINDS}
        self.shape: dict[str, dict[int, float]] = {k: {} for k in KINDS}
        self.sum = dict.fromkeys(KINDS, 0.0)
        #: Of a unit of this many words, against the mean.
        self.length = np.array([0.3, 0.6, 1.0, 1.0, 1.0, 1.0])
        self.ends = 0.15  # share of events that are known ends
        self.gap = GAP
        self.widths: tuple[int, ...] = ()

    def _by_shape(self, kind: str, codes: np.ndarray) -> np.ndarray:
        values, where = np.unique(codes, return_inverse=True)
        of = self.shape[kind]
        return np.array([of.get(int(v), 0.0) for v in values])[where]

    def odds(self, kb: np.ndarray, sb: np.ndarray, ka: np.ndarray, sa: np.ndarray) -> np.ndarray:
        """Odds of an event between two words, without regard to length."""
        if not len(kb):
            return np.zeros(0)
        h = kb % BUCKETS
        back = np.minimum((self._by_shape("end", sb) / self.ends + np.where(sb > 0, 0.9, 0.5)) / (self._by_shape("total", sb) + 1.0), 1.0)
        total, end, event = (self.table[t][h].astype(np.float64) for t in ("total", "end", "event"))
        p = np.minimum((end / self.ends + BACK_OFF * back) / (total + BACK_OFF), 1.0)
        if self.sum["event"]:
            p = (10 * p + event) / (10 + total)
        p = np.clip(p, 1e-3, 1 - 1e-3)
        o = p / (1 - p)
        if self.sum["no"]:
            scale = self.sum["yes"] / self.sum["no"]
            like = (self._by_shape("yes", sa) + 0.5) / (self._by_shape("no", sa) * scale + 0.5)
            g = ka % BUCKETS
            o = o * (self.table["yes"][g] + BACK_OFF * np.minimum(1.0, like)) / (self.table["no"][g] * scale + BACK_OFF)
        return np.where(sb == GAP_CODE, self.gap / (1 - self.gap), o)

    def posteriors(self, odds: list[float], words: list[int]) -> list[float]:
        """The chance of an event at each possible boundary, by forward-backward over the words since the last boundary."""
        n = len(odds)
        length = self.length.tolist()
        if n == 1:
            x = odds[0] * length[words[0] - 1]
            return [x / (1 + x)]
        # weights: an event counts odds x length, none counts 1; the state is the words since the last event
        fwd = [[0.0] * STATES]
        fwd[0][words[0] - 1] = 1.0
        for i in range(1, n):
            row, d, o = fwd[i - 1], words[i], odds[i - 1]
            new, yes = [0.0] * STATES, 0.0
            for s, v in enumerate(row):
                if v:
                    yes += v * length[s]
                    t = s + d
                    new[t if t < STATES else STATES - 1] += v
            new[d - 1] += yes * o
            top = max(new)
            fwd.append([v / top for v in new])
        out = [0.0] * n
        back = [1.0] * (STATES + 1)  # of the state after the decision at i: 0 (an event) to STATES
        for i in range(n - 1, -1, -1):
            yes = no = 0.0
            for s, v in enumerate(fwd[i]):
                if v:
                    yes += v * length[s]
                    no += v * back[s + 1]
            yes *= odds[i] * back[0]
            out[i] = yes / (yes + no)
            if i:
                o, d = odds[i] * back[0], words[i]
                then = [o * length[s] + back[s + 1] for s in range(STATES)]  # of the state at i
                back = [then[s + d - 1 if s + d < STATES else STATES - 1] for s in range(STATES + 1)]
                top = max(back)
                back = [v / top for v in back]
        return out


KINDS = ["total", "end", "event", "yes", "no"]


def decide(model: Model, whole, running, size, e, n, odds, words, least: float = 0.5) -> list[tuple[int, int]]:
    """The units of a text, from its spans and possible boundaries."""
    out = [(whole[i], whole[i + 1]) for i in range(0, len(whole), 2)]
    at = 0
    for r, k in enumerate(size):
        start, hi = running[2 * r], running[2 * r + 1]
        if k:
            for i, p in enumerate(model.posteriors(odds[at : at + k], words[at : at + k]), at):
                if p >= least and e[i] > start:
                    out.append((start, e[i]))
                    start = n[i]
            at += k
        if start < hi:
            out.append((start, hi))
    out.sort()
    return out


def divide(text: str | None, model: Model, least: float = 0.5) -> list[tuple[int, int]]:
    if text is None or not text.strip():
        return []
    whole, running, size, e, n, kb, sb, ka, sa, words, _ = parts(text, model.widths)
    odds = model.odds(np.array(kb, dtype=np.int64), np.array(sb, dtype=np.int64), np.array(ka, dtype=np.int64), np.array(sa, dtype=np.int64))
    return decide(model, whole, running, size, e, n, odds.tolist(), words, least)


def taken_apart(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """(doc_id and the columns of `_PARTS`) of every text that isn't blank, cut from its lineage, and the usual widths."""

    @pandas_udf(IntegerType())
    def widest(texts: pd.Series) -> pd.Series:
        return pd.Series([width(t) if t else 0 for t in texts], dtype="int32")

    hist = docs.where(F.col("text").contains("\n")).select(widest("text").alias("w")).where(F.col("w").between(NARROWEST, WIDEST)).groupBy("w").count().collect()  # at most 51 rows
    by = {r["w"]: r["count"] for r in hist}
    usual = float(np.median([by.get(w, 0) for w in range(NARROWEST, WIDEST + 1)]))
    widths = tuple(w for w in range(NARROWEST, WIDEST + 1) if by.get(w, 0) > 4 * max(1.0, usual) and by.get(w, 0) > by.get(w + 1, 0))

    @pandas_udf(_PARTS)
    def apart(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parts(t, widths) for t in texts], columns=_PARTS.names)

    some = docs.where(F.col("text").rlike(r"(?U)\S"))
    return cut(some.select("doc_id", apart.asNondeterministic()("text").alias("p")).select("doc_id", "p.*")), widths


def _fill(model: Model, rows: pd.DataFrame) -> None:
    """Put collected sums (kind, shape, key, value) into the tables."""
    for k, kind in enumerate(KINDS):
        g = rows[rows["kind"] == k]
        words, shapes = g[~g["shape"]], g[g["shape"]]
        t = np.zeros(BUCKETS, dtype=np.float32)
        t[words["key"].to_numpy(dtype=np.int64)] = words["value"].to_numpy()
        model.table[kind] = t
        model.shape[kind] = dict(zip(shapes["key"].astype(int), shapes["value"], strict=True))
        model.sum[kind] = float(t.sum())
    if model.sum["event"]:
        model.ends = min(max(model.sum["end"] / model.sum["event"], 0.01), 1.0)
    g = rows[rows["kind"] == len(KINDS)].set_index("key")["value"]
    model.gap = min((GAP * GAP_WEIGHT + g.get(1, 0.0)) / (GAP_WEIGHT + g.get(0, 0.0)), 1 - 1e-3)


def train(spark: SparkSession, apart: DataFrame, widths: tuple[int, ...], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the distinct pairs of the whole corpus."""
    model = Model()
    model.widths = widths
    null = F.lit(None).cast("long")
    cands = apart.select(F.explode(F.arrays_zip("kb", "sb", "ka", "sa")).alias("p")).select("p.*")
    tails = apart.select(F.explode("tail").alias("p")).select("p.*")
    ends = tails.select("kb", "sb", null.alias("ka"), null.cast("int").alias("sa"))
    starts = tails.select(null.alias("kb"), null.cast("int").alias("sb"), "ka", "sa")
    pairs = cut(cands.unionByName(ends).unionByName(starts).groupBy("kb", "sb", "ka", "sa").agg(F.count("*").alias("n")))
    for k in range(rounds + 1):
        _fill(model, _expect(spark, pairs, model if k else None))
    return model


def expected(pairs: pd.DataFrame, model: Model | None) -> pd.DataFrame:
    """Sums (kind, shape, key, value) over pairs (kb, sb, ka, sa, n): ka is null at a known end, kb at a known start."""
    n = pairs["n"].to_numpy(dtype=np.float64)
    start, end = pairs["kb"].isna().to_numpy(), pairs["ka"].isna().to_numpy()
    codes = {c: pairs[c].fillna(0).to_numpy(dtype=np.int64) for c in ("kb", "sb", "ka", "sa")}
    gaps = ~start & (codes["sb"] == GAP_CODE)
    mid, got = ~start & ~end & ~gaps, []

    def add(kind: str, side: str, rows: np.ndarray, value: np.ndarray) -> None:
        for shape, keys in ((False, codes["k" + side][rows] % BUCKETS), (True, codes["s" + side][rows])):
            uniq, where = np.unique(keys, return_inverse=True)
            got.append(pd.DataFrame({"kind": KINDS.index(kind), "shape": shape, "key": uniq, "value": np.bincount(where, weights=value[rows], minlength=len(uniq))}))

    add("yes", "a", start, n)
    add("total", "b", ~start & ~gaps, n)
    add("end", "b", end, n)
    if model is not None:
        p = np.zeros(len(n))
        both = mid | gaps
        o = model.odds(*(codes[c][both] for c in ("kb", "sb", "ka", "sa")))
        p[both] = o / (1 + o)
        add("event", "b", end, n)
        add("event", "b", mid, p * n)
        add("no", "a", mid, (1 - p) * n)
        got.append(pd.DataFrame({"kind": len(KINDS), "shape": False, "key": [0, 1], "value": [n[gaps].sum(), (p * n)[gaps].sum()]}))
    return pd.concat(got)


def _expect(spark: SparkSession, pairs: DataFrame, model: Model | None) -> pd.DataFrame:
    sent = spark.sparkContext.broadcast(model) if model else None

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield expected(pdf, sent.value if sent else None)

    summed = pairs.mapInPandas(sums, "kind int, shape boolean, key long, value double").groupBy("kind", "shape", "key").agg(F.sum("value").alias("value"))
    return summed.toPandas()  # at most 5 x BUCKETS rows and the shapes


def units(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per unit: doc_id, start_char, end_char."""
    apart, widths = taken_apart(spark, docs)
    sent = spark.sparkContext.broadcast(train(spark, apart, widths))

    @pandas_udf(ArrayType(StructType().add("start_char", IntegerType()).add("end_char", IntegerType())))
    def divided(whole: pd.Series, running: pd.Series, size: pd.Series, e: pd.Series, n: pd.Series, kb: pd.Series, sb: pd.Series, ka: pd.Series, sa: pd.Series, words: pd.Series) -> pd.Series:
        m = sent.value
        flat = [np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for x in (kb, sb, ka, sa)]
        odds = m.odds(*flat).tolist()
        out, at = [], 0
        for w, r, z, a, b, d in zip(whole, running, size, e, n, words, strict=True):
            out.append(decide(m, w.tolist(), r.tolist(), z.tolist(), a.tolist(), b.tolist(), odds[at : at + len(a)], d.tolist()))
            at += len(a)
        return pd.Series(out)

    cols = ["whole", "running", "size", "e", "n", "kb", "sb", "ka", "sa", "words"]
    return apart.select("doc_id", F.explode(divided(*cols)).alias("u")).select("doc_id", "u.*")
