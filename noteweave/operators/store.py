"""The encounter store: six tables kept as Parquet, with search, paging, rewrites, analytics and run logs.

Parquet has no MERGE, so an upsert is the old rows without the new keys, united with the new rows; a delete is an anti
join over the document and all its children.

Cases: null search terms match all; `%` and `_` in a term are wildcards; ties of an ordering go to the id; a ratio over no
rows is 0; empty tables give empty results (one row for totals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a text search looks into.
SEARCHED = ["document_id", "filename", "status", "text"]


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each key, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def search(docs: DataFrame, term: str | None = None, status: str = "ALL", having: DataFrame | None = None) -> DataFrame:
    """Documents with a status, a term in one of the searched columns, and (semi join) a row in `having`."""
    out = docs
    if status != "ALL":
        out = out.where(F.col("status") == status)
    if term:
        hit: Column = F.lit(False)
        for c in SEARCHED:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
        out = out.where(hit)
    return out.join(having.select("document_id").distinct(), "document_id", "left_semi") if having is not None else out


def page(docs: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page, the newest first. Paging is the feature; only limit + offset rows are sorted out of each task."""
    return docs.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_cascade(gone: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    keys = gone.select(key).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}


def write(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Store tables as Parquet; `folder` is any path the cluster shares."""
    for name, t in tables.items():
        t.write.mode(mode).parquet(f"{folder}/{name}")


def totals(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    d = docs.agg(F.count("*").alias("n_documents"), F.round(F.coalesce(F.avg("word_count"), F.lit(0.0)), 2).alias("avg_words"))
    m = mentions.agg(F.count("*").alias("n_mentions"), F.count_if(F.col("role") == "PRIMARY").alias("n_primary"), F.count_if(~F.coalesce("is_authorized", F.lit(True))).alias("n_refused"))
    ratio = F.round(100.0 * F.count_if("is_authorized") / F.greatest(F.count("*"), F.lit(1)), 1).alias("authorized_percent")
    return d.crossJoin(m).crossJoin(mentions.agg(ratio))  # three rows of one


def top_terms(mentions: DataFrame, role: str, k: int = 10) -> DataFrame:
    """The k most frequent terms of a role; ties go to the term. The top k is the feature."""
    t = mentions.where((F.col("role") == role) & (F.trim("raw_term") != "")).groupBy(F.lower(F.trim("raw_term")).alias("term")).agg(F.count("*").alias("n"))
    return t.orderBy(F.col("n").desc(), "term").limit(k)


def status_rollup(docs: DataFrame) -> DataFrame:
    """Documents by status and source type, with subtotals ('ALL')."""
    s, t = F.coalesce("status", F.lit("NONE")), F.coalesce("source_type", F.lit("NONE"))
    r = docs.select(s.alias("status"), t.alias("source_type")).rollup("status", "source_type").agg(F.count("*").alias("n"))
    return r.fillna("ALL", ["status", "source_type"])


def consolidate(mentions: DataFrame) -> DataFrame:
    """One row per document and term: PRIMARY wins, the surest confidence stays."""
    g = mentions.where(F.trim("raw_term") != "").groupBy("document_id", F.lower(F.trim("raw_term")).alias("term"))
    return g.agg(F.max(F.when(F.col("role") == "PRIMARY", 1).otherwise(0)).alias("is_primary"), F.max(F.coalesce("candidate_confidence", F.lit(0.0))).alias("confidence"), F.count("*").alias("n_merged"))


def subsume(coded: DataFrame, rules: DataFrame) -> DataFrame:
    """Coded rows (group_id, code) without those that a stronger code of the same group covers; rules (strong, weak)."""
    covered = coded.join(rules, coded["code"] == rules["strong"]).select("group_id", F.col("weak").alias("code"))
    return coded.join(covered, ["group_id", "code"], "left_anti")


def open_abstentions(mentions: DataFrame) -> DataFrame:
    """Refused mentions whose term is not accepted elsewhere in the same document."""
    m = mentions.where(F.trim("raw_term") != "").select("document_id", F.lower(F.trim("raw_term")).alias("term"), F.coalesce("is_authorized", F.lit(True)).alias("ok"))
    return m.where("not ok").select("document_id", "term").distinct().join(m.where("ok").select("document_id", "term").distinct(), ["document_id", "term"], "left_anti")


def document_status(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """SUCCESS if all mentions were accepted, PARTIAL if some, ABSTAINED if none or there is none."""
    n = mentions.groupBy("document_id").agg(F.count_if(F.coalesce("is_authorized", F.lit(True))).alias("ok"), F.count("*").alias("n"))
    d = docs.select("document_id").distinct().join(n, "document_id", "left").fillna(0)
    return d.select("document_id", F.when(F.col("ok") == 0, "ABSTAINED").when(F.col("ok") < F.col("n"), "PARTIAL").otherwise("SUCCESS").alias("outcome"))


def audit(docs: DataFrame, mentions: DataFrame, snippets: DataFrame) -> DataFrame:
    """Each mention with its document's newest status and its number of snippets."""
    d = docs.groupBy("document_id").agg(F.max_by("status", F.struct("received_at", "id")).alias("status"))
    s = snippets.where("diagnosis_id is not null").groupBy("diagnosis_id").agg(F.countDistinct("snippet_id").alias("n_snippets"))
    return mentions.join(d, "document_id", "left").join(s, "diagnosis_id", "left").select("diagnosis_id", "document_id", F.coalesce("status", F.lit("NONE")).alias("status"), F.coalesce("n_snippets", F.lit(0)).alias("n_snippets"))


# ---- run logs: events of threads (user_id) with steps (event_type)


def thread_latest(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_step"), F.max("ts").alias("last_ts"), F.count("*").alias("n_steps"))


def step_progress(events: DataFrame, n_total: int = 10) -> DataFrame:
    n = events.groupBy("user_id").agg(F.countDistinct("event_type").alias("n"))
    return n.select("user_id", F.round(F.least(F.lit(100.0), 100.0 * F.col("n") / n_total), 1).alias("percent"))


def latency_breakdown(events: DataFrame) -> DataFrame:
    """Seconds from each step of a thread to its next, by kind of step."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = events.withColumn("ms", (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000)
    return d.where("ms is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 2).alias("avg_ms"), F.max("ms").alias("max_ms"))


def batch_status(docs: DataFrame) -> DataFrame:
    """Counters of each site's batch."""
    return docs.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if(F.trim("text") != "").alias("n_ready"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_empty"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))


def run_rate(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events in tumbling windows; the same expression serves the stream."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


def run_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each thread: events without a longer gap."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))
