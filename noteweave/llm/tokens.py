"""Token ids of a public byte-level BPE vocabulary (problem 8).

Each partition reduces its texts to their distinct words, encodes the new ones in DuckDB and looks every word up.
In DuckDB the words are token-position rows; a recursive query joins neighbouring rows with the merge table and
contracts the leftmost pairs of minimum rank of each word until none is left; an ordered aggregation gives the ids.

Scale: no shuffle; the merge table (as large as the vocabulary, about 1.2 MB) is sent to the executors, the words are
kept per Python worker up to `CACHE_WORDS` and then dropped, so memory doesn't grow with the data. A recursive query
stops after so many rounds that it never holds more than `ROWS` rows, and goes on from where it stopped: a word of any
length is encoded whole.

Cases: null and empty texts give an empty list; strings of special tokens are ordinary text; repeated rows repeat.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

#: Folder of the vocabulary files; the environment may name another.
TOKENIZERS = os.environ.get("NOTEWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits a text before the merges of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per Python worker, words encoded at once, and rows a recursive query may hold.
CACHE_WORDS, BATCH_BYTES, ROWS = 400_000, 1 << 16, 2_000_000

_STEP = """
WITH RECURSIVE s(it, w, p, t) AS (
  SELECT 0, w, p, t FROM state
  UNION ALL
  SELECT it + 1, w, p, CASE WHEN take THEN n ELSE t END FROM (
    SELECT *, lag(take) OVER (PARTITION BY w ORDER BY p) AS eaten FROM (
      SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, i - hi ORDER BY p) % 2 = 1 AS take FROM (
        SELECT *, row_number() OVER (PARTITION BY w, hit ORDER BY p) AS hi FROM (
          SELECT *, coalesce(r = min(r) OVER (PARTITION BY w), false) AS hit, min(r) OVER (PARTITION BY w) AS low FROM (
            SELECT a.*, m.r, m.n FROM (
              SELECT it, w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS nt, row_number() OVER (PARTITION BY w ORDER BY p) AS i
              FROM s WHERE it < {rounds}
            ) a LEFT JOIN merges m ON m.a = a.t AND m.b = a.nt
          )
        ) WHERE low IS NOT NULL
      )
    )
  ) WHERE NOT coalesce(eaten, false)
)
SELECT w, any_value(s.it) AS it, list(t ORDER BY p) AS ids, list(p ORDER BY p) AS ps
FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) l USING (w, it) GROUP BY w
"""


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the 256 bytes, and the merges as rows (left id, right id, rank, new id)."""
    with open(os.path.join(folder or TOKENIZERS, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(pairs)], dtype=np.int32)
    return np.array([vocab[letter[b]] for b in range(256)], dtype=np.int32), merges


class Encoder:
    """Encodes words in one DuckDB connection and remembers them."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        import duckdb
        import regex

        self.split = regex.compile(PATTERN).findall
        self.byte_ids = byte_ids
        self.known: dict[str, list[int]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        m = pd.DataFrame(merges, columns=["a", "b", "r", "n"])  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {}
        batch, size = [], 0
        for w in words:
            b = w.encode()
            if batch and size + len(b) > BATCH_BYTES:
                self._encode(batch)
                batch, size = [], 0
            batch.append((w, b))
            size += len(b)
        if batch:
            self._encode(batch)

    def _encode(self, batch: list[tuple[str, bytes]]) -> None:
        raw = b"".join(b for _, b in batch)
        lens = np.array([len(b) for _, b in batch])
        w = np.repeat(np.arange(len(batch), dtype=np.int32), lens)
        p = (np.arange(len(raw)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        t = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]
        while len(w):
            rounds = max(4, ROWS // len(w))
            state = pd.DataFrame({"w": w, "p": p, "t": t})  # noqa: F841
            got = self.db.execute(_STEP.format(rounds=rounds)).fetchall()
            again = []
            for k, it, ids, ps in got:
                if it == rounds:
                    again.append((k, ids, ps))
                else:
                    self.known[batch[k][0]] = ids
            w = np.array([k for k, ids, _ in again for _ in ids], dtype=np.int32)
            p = np.array([x for _, _, ps in again for x in ps], dtype=np.int32)
            t = np.array([x for _, ids, _ in again for x in ids], dtype=np.int32)

    def batch(self, texts: pd.Series) -> list[list[list[int]]]:
        """For each text its words' ids."""
        split = [self.split(t) if t else [] for t in texts]
        new = {w for ws in split for w in ws}
        held = self.known
        self.learn([w for w in new if w not in held])
        if held is not self.known:  # forgotten on the way: this batch's words are all needed
            self.learn([w for w in new if w not in self.known])
        known = self.known
        return [[known[w] for w in ws] for ws in split]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(data: tuple[str, np.ndarray, np.ndarray]) -> Encoder:
    """This worker's encoder of a vocabulary, known by its content."""
    key, byte_ids, merges = data
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(byte_ids, merges)
    return _ENCODERS[key]


def _send(spark: SparkSession, name: str, folder: str | None):
    byte_ids, merges = vocabulary(name, folder)
    return spark.sparkContext.broadcast((xxhash.xxh3_128_hexdigest(byte_ids.tobytes() + merges.tobytes()), byte_ids, merges))


def encode(spark: SparkSession, text: Column, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """The ids of `text` as an array of int, empty for null and empty texts."""
    sent = _send(spark, name, folder)

    @pandas_udf(ArrayType(IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(sent.value)
        for texts in batches:
            yield pd.Series([np.array([i for x in ws for i in x], dtype=np.int32) for ws in enc.batch(texts)], dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def count_tokens(spark: SparkSession, text: Column, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """How many tokens `text` has; 0 for null and empty texts."""
    sent = _send(spark, name, folder)

    @pandas_udf(IntegerType())
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(sent.value)
        for texts in batches:
            yield pd.Series([sum(len(x) for x in ws) for ws in enc.batch(texts)], dtype="int32")

    return n(F.coalesce(text, F.lit("")))


def encode_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", encode(spark, F.col("text")).alias("ids"))
