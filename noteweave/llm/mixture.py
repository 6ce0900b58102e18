"""Mixing of sources to target weights by weighted fair queueing (problem 9).

The documents of each source are shuffled (by a hash with a seed) and queue up; a document's virtual finish time is the
number of tokens of its source up to and with it, over the source's weight. The queues are merged in the order of these
times and cut at the total budget. A small source queues up again until its `max_repeats` are used.

Budget: as given; else the largest total at which every source that has tokens still reaches its share. With a larger
budget a source ends once its repeats are used up, and the report says that it fell short. Sources with a target but
without tokens can't be reached: their share goes to the others in proportion, and the report says so. Documents whose
source is null or has no target aren't used.

Scale: the corpus is tokenised once; only (doc_id, source, tokens) goes on, cut from its lineage. Running totals inside a source would put a source in one task. Instead the shuffled order is divided into
buckets by the hash; bucket totals (few, and in order) give each bucket its start, and the running total is taken
within a bucket. The buckets follow the number of documents (`PER_BUCKET` in each). The final order is a range sort.

Cases: null, empty and blank texts have 0 tokens or few, and take their place like any other; equal hashes are ordered by
doc_id; a target of 0 or a cap of 0 takes none; empty tables give an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.llm.tokens import count_tokens
from noteweave.session import cut, spread

#: Documents in a bucket, and the seed of the shuffle.
PER_BUCKET, SEED = 20_000, 20260701


def sized(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens), computed once."""
    return cut(spread(documents.select("doc_id", "source", "text"), spark).select("doc_id", "source", count_tokens(spark, F.col("text")).alias("n_tokens")))


def source_sizes(docs: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """Targets with their documents and tokens, the normalised weight and the budget (one row per source)."""
    sums = docs.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(sums, "source", "left").fillna(0, ["n_docs", "tokens", "max_repeats"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy()  # one row per source
    t = t.withColumn("weight", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(every)))
    reach = F.min(F.col("tokens") * F.col("max_repeats") / F.col("weight")).over(every)
    return t.withColumn("budget", reach if budget is None else F.lit(float(budget)))


def queue(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every use of a document that the mixture may make, with its virtual finish time."""
    buckets = max(1, docs.count() // PER_BUCKET)
    use = F.broadcast(sizes.where("weight is not null").select("source", "tokens", "max_repeats", "weight", "budget"))  # one row per source
    d = docs.join(use, "source").withColumn("h", F.xxhash64("doc_id", F.lit(SEED)))
    d = d.withColumn("bucket", F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * buckets).cast("int"))
    totals = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("inside", inside).join(before, ["source", "bucket"])
    d = d.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
    finish = (F.col("before") + F.col("inside") + (F.col("repeat_no") - 1) * F.col("tokens")) / F.col("weight")
    return d.withColumn("finish", finish).where("finish <= budget").select("doc_id", "source", "repeat_no", "n_tokens", "finish")


def mixture(spark: SparkSession, documents: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """The mixture in its order: doc_id, source, repeat_no, n_tokens, finish. `budget`: total tokens."""
    docs = sized(spark, documents)
    return queue(docs, source_sizes(docs, targets, budget)).orderBy("finish", "source", "doc_id", "repeat_no")


def shares(spark: SparkSession, documents: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """The report: target and actual share of each source, with what there was and what was used."""
    docs = sized(spark, documents)
    sizes = source_sizes(docs, targets, budget)
    used = queue(docs, sizes).groupBy("source").agg(F.count("*").alias("n_used"), F.max("repeat_no").alias("most_repeats"), F.sum("n_tokens").alias("tokens_used"))
    all_used = F.sum("tokens_used").over(Window.partitionBy())  # one row per source
    r = sizes.join(used, "source", "left").fillna(0, ["n_used", "most_repeats", "tokens_used"])
    short = F.col("tokens") * F.col("max_repeats") < F.col("budget") * F.col("weight") * (1 - 1e-9)
    return r.select(
        "source", "target_share", "max_repeats", "n_docs", F.col("tokens").alias("tokens_there"), F.round("weight", 6).alias("reachable_share"),
        "n_used", "most_repeats", "tokens_used", F.round(F.coalesce(F.col("tokens_used") / F.nullif(all_used, F.lit(0)), F.lit(0.0)), 6).alias("actual_share"),
        F.when(F.col("weight").isNull(), "no tokens to draw from").when(short, "repeats used up").otherwise("reached").alias("outcome"),
    )
