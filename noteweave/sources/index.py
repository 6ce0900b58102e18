"""The retrieval index of a catalogue: built once, written with a version, and read back.

`ensure_index` reads an index if it is there and was made by this version from the same rows, else it builds it. Searching
a loaded index gives what searching the catalogue gives, without tokenising or counting anything again.

Cases: an empty catalogue gives an empty index; a folder without a version is no index; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.operators import retrieval as R

#: Raised when what is stored changes.
VERSION = 1
TABLES = ["docs", "postings", "idf", "vectors"]


@dataclass
class Index:
    """docs (row_id, code, description, tokens), postings (row_id, term, tf, dl), idf (term, df, avgdl, idf), vectors (id, vec)."""

    docs: DataFrame
    postings: DataFrame
    idf: DataFrame
    vectors: DataFrame

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, row_id, score, rank) of queries (query_id, tokens)."""
        return R.top_k(R.bm25_on(queries, self.postings, self.idf).withColumn("score", F.round("score", 4)), k)

    def nearest(self, texts: DataFrame, k: int) -> DataFrame:
        """(query_id, row_id, score, rank) of texts (id, text)."""
        return R.semantic(texts, self.vectors, k)


def build_index(rows: DataFrame) -> Index:
    """The index of catalogue rows (row_id, code, description, inclusion_terms, synonyms)."""
    text = F.concat_ws(" ", T.unformat_code(F.col("code")), "description", "inclusion_terms", "synonyms")
    docs = rows.where("description is not null").select("row_id", "code", "description", T.clinical_tokens(text).alias("tokens"))
    post = R.postings(docs)
    vectors = R.dense(R.hashed_features(docs.select(F.col("row_id").alias("id"), F.col("description").alias("text"))))
    return Index(docs, post, R.idf_table(post, R.corpus_size(docs)), vectors)


def fingerprint(rows: DataFrame) -> str:
    """What the rows hold, whatever their order: a count and a sum of hashes."""
    h = F.xxhash64("row_id", "code", "description", "inclusion_terms", "synonyms").cast("decimal(38,0)")
    r = rows.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
    return f"{VERSION}:{r['n']}:{r['h']}"


def write_index(index: Index, folder: str, mark: str) -> None:
    """The tables, and last their version: a folder that was left half-written has none."""
    spark = index.docs.sparkSession
    for name in TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version")


def load_index(spark: SparkSession, folder: str, mark: str | None = None) -> Index | None:
    """The index of a folder; None if there is none, or one of another version or of other rows."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(f"{folder}/version").first()
    except AnalysisException:
        return None
    if found is None or (mark is not None and found["mark"] != mark) or found["mark"].split(":")[0] != str(VERSION):
        return None
    return Index(*[spark.read.parquet(f"{folder}/{name}") for name in TABLES])


def ensure_index(spark: SparkSession, rows: DataFrame, folder: str) -> Index:
    """The index of these rows from the folder, built and written there if need be."""
    mark = fingerprint(rows)
    got = load_index(spark, folder, mark)
    if got is None:
        write_index(build_index(rows), folder, mark)
        got = load_index(spark, folder, mark)
    return got
