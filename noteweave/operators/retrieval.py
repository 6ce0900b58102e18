"""Retrieval over a reference table: BM25, hashed vectors, exact vector search, fusion and retries.

An index is a set of tables (postings, lengths, idf; packed vector blocks), so it can be written and read as Parquet.
Lexical search joins query terms with postings only. Vector search compares packed blocks of queries with packed blocks of
rows (a stated query set against all rows, in blocks); the best k of a block are kept before any shuffle.

Cases: queries and rows without tokens match nothing; zero vectors and vectors of another length score 0 or are left out;
ties go to the smaller row id; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.functions import values as V
from noteweave.operators import matching, terms
from noteweave.session import cut

#: Public defaults of BM25, and the weights of fusion.
K1, B, EPSILON = 1.5, 0.75, 0.25
SEMANTIC, LEXICAL, ONE_SIDED = 0.6, 0.4, 0.85
#: Dimensions of hashed vectors; vectors in a packed block.
DIMENSIONS, BLOCK = 384, 256
#: Hits of either side that are fused; hits below which evidence is searched too; characters of the evidence searched.
WINDOW, FEW, EVIDENCE = 350, 5, 120


def postings(docs: DataFrame) -> DataFrame:
    """(row_id, term, tf, dl) of docs (row_id, tokens)."""
    each = docs.select("row_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return each.groupBy("row_id", "term", "dl").agg(F.count("*").alias("tf"))


def idf_table(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf): negative values are raised to a share of the mean over all terms. n_docs: one row (n, avgdl)."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(n_docs)).select("term", "df", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # one row on the right
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", "avgdl", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def bm25(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, row_id, score) > 0 of queries (query_id, tokens); repeated query tokens count again."""
    post = postings(docs)
    return bm25_on(queries, post, idf_table(post, corpus_size(docs)))


def bm25_on(queries: DataFrame, post: DataFrame, idf: DataFrame) -> DataFrame:
    """The same, on postings and idf as they are (of an index, say)."""
    q = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    hit = q.join(post.join(idf, "term"), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "row_id").agg(F.sum(part).alias("score")).where("score > 0")


def top_k(hits: DataFrame, k: int, by: str = "query_id", score: str = "score") -> DataFrame:
    """The best k of each query; ties go to the smaller row id."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col("row_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def forms(t: Column) -> Column:
    """A token, its related words and its singular."""
    rel, none = T.literal_map(V.RELATED), F.array().cast("array<string>")
    single = F.when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 4), F.array(t.substr(F.lit(1), F.length(t) - 1))).otherwise(none)
    return F.concat(F.array(t), F.coalesce(F.try_element_at(rel, t), none), single)


def kinds(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, tokens) as lexical search sees them: in order, with a blank for each token of which no row holds any form.

    Queries with equal tokens here have the same hits and scores, so such as differ in misspelt words only are searched once.
    """
    each = queries.select("query_id", F.explode("tokens").alias("t"))
    held = docs.select(F.explode("tokens").alias("form")).distinct()
    known = each.select("t").distinct().select("t", F.explode(forms(F.col("t"))).alias("form")).join(held, "form", "left_semi").select("t", F.lit(True).alias("known")).distinct()
    token = F.when(F.col("known"), F.col("t")).otherwise(F.lit(""))
    return each.join(known, "t", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(token)).alias("tokens"))


def lexical(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, lexical): half the share of the best raw score, half the share of query tokens covered (by themselves or a related form)."""
    hits = top_k(bm25(queries, docs), k).withColumn("raw", F.round("score", 4))
    best = F.max("raw").over(Window.partitionBy("query_id"))
    full = hits.withColumn("best", best).join(queries.select("query_id", F.transform("tokens", forms).alias("qt")), "query_id").join(docs.select("row_id", F.col("tokens").alias("dt")), "row_id")
    cover = F.size(F.filter("qt", lambda fs: F.arrays_overlap(F.col("dt"), fs))) / F.size("qt")
    return full.select("query_id", "row_id", F.round(0.5 * F.col("raw") / F.col("best") + 0.5 * cover, 4).alias("lexical"))


# ---- vectors


def hashed_features(texts: DataFrame) -> DataFrame:
    """(id, idx, weight) of unit length: words count 1.5 and letter triples 0.5, by hash place and hash sign."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    triple = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 2)), lambda i: F.concat(F.lit("c_"), F.substring(w, i, F.lit(3))))))
    feats = F.concat(F.transform(words, lambda w: F.struct(F.concat(F.lit("w_"), w).alias("f"), F.lit(1.5).alias("v"))), F.transform(triple, lambda t: F.struct(t.alias("f"), F.lit(0.5).alias("v"))))
    h = F.conv(F.substring(F.md5("x.f"), 1, 8), 16, 10).cast("bigint")
    each = texts.select("id", F.explode(feats).alias("x")).select("id", (h % DIMENSIONS).cast("int").alias("idx"), F.when(h % 2 == 0, F.col("x.v")).otherwise(-F.col("x.v")).alias("v"))
    sums = each.groupBy("id", "idx").agg(F.sum("v").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return sums.withColumn("norm", norm).where("norm > 0").select("id", "idx", (F.col("v") / F.col("norm")).alias("weight"))


def dense(features: DataFrame) -> DataFrame:
    """(id, vec) from sparse features."""
    m = F.map_from_entries(F.collect_list(F.struct("idx", "weight")))
    return features.groupBy("id").agg(m.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def _blocks(vectors: DataFrame, name: str) -> DataFrame:
    """Vectors packed by a hash of their id into blocks of about BLOCK."""
    n = max(1, -(-vectors.count() // BLOCK))
    b = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)
    return vectors.where("vec is not null").groupBy(b).agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list(F.col("vec").cast("array<double>")).alias(f"{name}_vecs"))


def vector_search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, score): exact cosine top k of queries (id, vec) against all rows (id, vec), in blocks."""
    q, r = _blocks(queries, "q"), _blocks(rows, "r")

    def best(batches):
        for pdf in batches:
            out = []
            for qi, qv, ri, rv in zip(pdf["q_ids"], pdf["q_vecs"], pdf["r_ids"], pdf["r_vecs"], strict=True):
                size = max(len(v) for v in qv)
                keep_q, keep_r = [i for i, v in enumerate(qv) if len(v) == size], [i for i, v in enumerate(rv) if len(v) == size]
                if not keep_q or not keep_r:
                    continue
                a, b = np.stack([qv[i] for i in keep_q]), np.stack([rv[i] for i in keep_r])
                na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                s = np.round((a @ b.T) / np.where(na > 0, na, 1)[:, None] / np.where(nb > 0, nb, 1)[None], 6)
                ids = np.asarray(ri)[keep_r]
                for x, i in enumerate(keep_q):
                    order = np.lexsort((ids, -s[x]))[:k]
                    out += [(qi[i], int(ids[j]), float(s[x, j])) for j in order]
            yield pd.DataFrame(out, columns=["query_id", "row_id", "score"])

    pairs = q.crossJoin(r)  # blocks of a stated query set against blocks of all rows
    return top_k(pairs.mapInPandas(best, "query_id bigint, row_id bigint, score double"), k)


def fused(lex: DataFrame, sem: DataFrame) -> DataFrame:
    """(query_id, row_id, score, provenance): weighted sum of both sides, or a share of the only one."""
    both = lex.join(sem, ["query_id", "row_id"], "full_outer")
    score = F.when(F.col("lexical").isNotNull() & F.col("semantic").isNotNull(), SEMANTIC * F.col("semantic") + LEXICAL * F.col("lexical")).otherwise(ONE_SIDED * F.coalesce("semantic", "lexical"))
    where = F.when(F.col("lexical").isNotNull() & F.col("semantic").isNotNull(), "hybrid").when(F.col("semantic").isNotNull(), "vector").otherwise("bm25")
    return both.select("query_id", "row_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("score"), where.alias("provenance"))


def fuse(lex: DataFrame, sem: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The best k of each query by the fused score, with their rank."""
    return top_k(fused(lex, sem).where(F.col("score") >= least), k)


def top_k_by_system(scored: DataFrame, systems: DataFrame, k: int) -> DataFrame:
    """(query_id, chapter, row_id, score, provenance, rank): the best k of each query in each chapter. systems: (row_id, chapter)."""
    each = scored.join(systems, "row_id").withColumn("key", F.struct("query_id", "chapter"))
    return top_k(each, k, by="key").select("query_id", "chapter", "row_id", "score", "provenance", "rank")


def semantic(texts: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, row_id, semantic) > 0 of texts (id, text) against all vectors (id, vec)."""
    hits = vector_search(dense(hashed_features(texts)), vectors, k)
    return hits.where("score > 0").select("query_id", "row_id", F.round("score", 4).alias("semantic"))


def hybrid(asked: DataFrame, docs: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    """The fused best k of asked (query_id, text) over windows of WINDOW on both sides."""
    q = asked.select("query_id", T.clinical_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    texts = asked.select(F.col("query_id").alias("id"), T.expand_abbreviations(F.col("text")).alias("text"))
    return fuse(lexical(q, docs, WINDOW), semantic(texts, vectors, WINDOW), k, least).select("query_id", "row_id", "score")


def retry(asked: DataFrame, docs: DataFrame, vectors: DataFrame, entries: DataFrame, k: int = 10, least: float = 0.35) -> DataFrame:
    """(query_id, row_id, score, round): the best k of asked (query_id, text, evidence) after up to three hybrid rounds.

    Round 2 searches the variations of queries without an exact match or with fewer than k hits, round 3 the beginning of
    the evidence of those without an exact match or with fewer than FEW hits, both with a lowered threshold. The best
    score of an entry is then weighed against its concept score. entries: (row_id, code, description).
    """

    def judged(hits: DataFrame) -> DataFrame:
        pairs = hits.withColumnRenamed("score", "found").join(entries, "row_id").join(asked.select("query_id", F.col("text").alias("concept"), "evidence"), "query_id")
        return matching.score_pairs(pairs)

    def still_open(hits: DataFrame, enough: int) -> DataFrame:
        state = judged(hits).groupBy("query_id").agg(F.max("exact").alias("has"), F.count("*").alias("n"))
        return asked.join(state, "query_id", "left").where(~F.coalesce("has", F.lit(False)) | (F.coalesce("n", F.lit(0)) < enough)).select("query_id", "text", "evidence")

    vectors = cut(vectors)
    one = cut(hybrid(asked, docs, vectors, k, least))
    varied = cut(terms.query_variations(still_open(one, k)).withColumn("text_id", F.xxhash64("variation")))
    texts = varied.select(F.col("text_id").alias("query_id"), F.col("variation").alias("text")).distinct()
    found = hybrid(texts, docs, vectors, k, max(0.20, least - 0.10)).withColumnRenamed("query_id", "text_id")
    two = cut(varied.join(found, "text_id").groupBy("query_id", "row_id").agg(F.max("score").alias("score")))
    late = still_open(union_best([one, two]), FEW).where("trim(evidence) <> ''")
    three = hybrid(late.select("query_id", F.col("evidence").substr(1, EVIDENCE).alias("text")), docs, vectors, k, max(0.15, least - 0.15))
    all_ = judged(union_best([one, two, three]))
    blend = F.greatest(F.col("found"), 0.8 * F.col("score") + 0.2 * F.col("found"))
    final = F.round(F.when(F.col("exact"), F.greatest(blend, F.lit(0.98))).otherwise(blend), 4)
    return top_k(all_.select("query_id", "row_id", final.alias("score"), "round"), k).select("query_id", "row_id", "score", "round")


def union_best(rounds: list[DataFrame]) -> DataFrame:
    """The best score of each (query_id, row_id) over several rounds, and the round it came from."""
    all_ = None
    for i, r in enumerate(rounds):
        x = r.select("query_id", "row_id", "score", F.lit(i + 1).alias("round"))
        all_ = x if all_ is None else all_.unionByName(x)
    return all_.groupBy("query_id", "row_id").agg(F.max("score").alias("score"), F.min_by("round", F.struct(-F.col("score"), F.col("round"))).alias("round"))
