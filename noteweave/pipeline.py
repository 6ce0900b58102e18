"""The batch pipeline: notes and mentions to coded, ranked and audited results, stage by stage with timings.

Every stage is a function from DataFrames to DataFrames; nothing is collected but row counts. A stage that fails is
reported as such and ends the run, with the stages before it kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.operators import catalogue, matching, mentions, notes, retrieval, store
from noteweave.operators import terms as terms_
from noteweave.session import cut
from noteweave.sources import documents


@dataclass
class Run:
    """What a run made and how long each stage took (milliseconds)."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    ms: dict[str, int] = field(default_factory=dict)
    error: str | None = None


def code_mentions(found: DataFrame, cat: DataFrame, docs: DataFrame, snippets: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(document_id, term, code, final, exact): the best entry of every term of a document, by lexical retrieval and the concept score.

    Terms are searched once for all that differ only in words that no entry knows, and meet an entry's words once for all
    documents. The evidence that a score looks at is the document's own: the mention's quotes (snippets) and the sentences
    that corroborate the term. All that counts of it are a few cues, so each term is decided once for each set of cues.
    """
    merged = cut(catalogue.merge_duplicates(catalogue.standard_rows(cat)))
    text = F.concat_ws(" ", "clean", "description", F.array_join("inclusion_terms", " "), F.array_join("synonyms", " "))
    entries = merged.select(F.col("first_ord").alias("row_id"), T.clinical_tokens(text).alias("tokens"))
    key = ["diagnosis_id"] if snippets is not None else []
    all_ = cut(found.where("raw_term is not null").select(*key, "document_id", F.lower(F.trim("raw_term")).alias("term")).where("term <> ''"))
    terms = all_.select("term").distinct()
    queries = terms.select(F.xxhash64("term").alias("query_id"), "term", T.clinical_tokens(F.col("term")).alias("tokens")).where(F.size("tokens") > 0)
    seen = cut(retrieval.kinds(queries, entries).select("query_id", F.xxhash64("tokens").alias("kind_id"), "tokens"))
    searched = seen.select(F.col("kind_id").alias("query_id"), "tokens").dropDuplicates(["query_id"])
    hits = retrieval.top_k(retrieval.lexical(searched, entries, 350), k, score="lexical").select(F.col("query_id").alias("kind_id"), "row_id", F.col("lexical").alias("retrieval_score"))
    known = merged.select(F.col("first_ord").alias("row_id"), F.col("formatted").alias("code"), "billable", matching.entry_parts(F.col("formatted"), F.col("description")).alias("__e"))
    words = queries.select("query_id", "term", matching.concept_parts(F.col("term")).alias("__c")).join(seen.select("query_id", "kind_id"), "query_id")
    pairs = matching.met_parts(words.join(hits, "kind_id").join(known, "row_id")).select("term", "code", "billable", "retrieval_score", "__e", "__m")
    quoted = all_.join(notes.merge_quotes(snippets), "diagnosis_id", "left") if snippets is not None else all_.withColumn("quotes", F.lit(None).cast("string"))
    named = quoted.groupBy("document_id", "term").agg(F.array_sort(F.collect_set("quotes")).alias("quotes"))
    cues = matching.text_cues(F.concat_ws(" ", "term", "evidence"))
    stated = cut(terms_.corroborate(named, docs).select("document_id", "term", cues.alias("__bits")))
    scored = matching.with_score(stated.select("term", "__bits").distinct().join(pairs, "term"))
    best = matching.best_match(scored, ["term", "__bits"])
    return stated.join(best, ["term", "__bits"]).select("document_id", "term", "code", "final", "exact")


def run(spark: SparkSession, docs: DataFrame, candidates: DataFrame, cat: DataFrame, folder: str | None = None, snippets: DataFrame | None = None) -> Run:
    """Sections, latest mentions, codes, roles and outcomes; written to `folder` if given (then timings are of the work)."""
    r = Run()

    def stage(name: str, make) -> None:
        if r.error:
            return
        began = time.time()
        try:
            t = make()
            if folder:
                t.write.mode("overwrite").parquet(f"{folder}/{name}")
                t = spark.read.parquet(f"{folder}/{name}")
            r.tables[name] = t
        except Exception as e:  # noqa: BLE001
            r.error = f"{name}: {e}"
        r.ms[f"{name}_ms"] = round(1000 * (time.time() - began))

    stage("parsing", lambda: notes.sections(docs))
    stage("extraction", lambda: notes.latest_mentions(candidates))
    stage("retrieval", lambda: code_mentions(r.tables["extraction"], cat, docs, snippets))
    stage("classification", lambda: notes.rank_roles(r.tables["extraction"]))
    stage("serialization", lambda: store.document_status(docs, r.tables["extraction"]))
    r.ms["total_ms"] = sum(r.ms.values())
    return r


def code_text(spark: SparkSession, text: str, cat: DataFrame) -> DataFrame:
    """One note: the catalogue entries it names, with polarity, the longest phrases only."""
    return mentions_of(spark.createDataFrame([(0, text)], "id long, text string"), cat)


def code_files(spark: SparkSession, path: str, cat: DataFrame) -> DataFrame:
    """Files of notes: the entries named in each; files that can't be read as text have a status and no entry."""
    files = documents.read_documents(spark, path).withColumn("id", F.xxhash64("path"))
    named = mentions_of(files.where("status = 'READY'").select("id", "text"), cat)
    return files.select("id", "path", "status").join(named, "id", "left")


def mentions_of(docs: DataFrame, cat: DataFrame) -> DataFrame:
    return mentions.longest(mentions.extract(docs, cat)).select("id", "line_no", "code", "phrase", "polarity")


def batch_report(files: DataFrame, seconds: float) -> DataFrame:
    """Counters of a batch and its throughput."""
    one = files.select("id", "status").distinct()
    return one.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "READY").alias("n_done"), F.count_if(F.col("status") != "READY").alias("n_failed")).withColumn("per_second", F.round(F.col("n") / max(seconds, 0.001), 2))
