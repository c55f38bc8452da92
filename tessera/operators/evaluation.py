"""Ranking quality: precision at k and at R, average precision, and their means.

results(query_id, rank, doc_id), ranks from 1; qrels(query_id, doc_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A query's results are ranked and its hits counted in blocks: so many by score, and so many ranks in each.
SCORE_BLOCKS, RANK_BLOCK = 200, 100_000
#: Queries up to which their block counts are broadcast. With more of them no query's results dominate, and the joins shuffle.
BROADCAST_QUERIES = 10_000

# Common English function words.
STOPWORDS = "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its more my no not of on or our out she so some than that the their them then there these they this to up was we were what when which who will with would you your".split()


def without_stopwords(words: Column, stopwords: list[str] = STOPWORDS) -> Column:
    stop = F.array(*(F.lit(w) for w in stopwords))
    return F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w)))


def _judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """results with hit, 1 if relevant."""
    return results.join(qrels.select("query_id", "doc_id", F.lit(1).alias("hit")).distinct(), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def _small(table: DataFrame, n_queries: int) -> DataFrame:
    """table, of at most SCORE_BLOCKS or so rows for each query, to be broadcast if the queries are few."""
    return F.broadcast(table) if n_queries <= BROADCAST_QUERIES else table


def _counted(hits: DataFrame, n_queries: int) -> DataFrame:
    """hits(query_id, rank) with upto, the hits of the query up to that rank: counts of blocks of ranks, then ranks within a block."""
    blocked = hits.withColumn("block", F.floor(F.col("rank") / RANK_BLOCK))
    before = _before(blocked)
    inner = Window.partitionBy("query_id", "block").orderBy("rank")
    return blocked.withColumn("within", F.row_number().over(inner)).join(_small(before, n_queries), ["query_id", "block"]).select("query_id", "rank", (F.col("base") + F.col("within")).alias("upto"))


def _before(blocked: DataFrame) -> DataFrame:
    """(query_id, block, base): rows of the query in lower blocks; the window sees one row for each block."""
    counts = blocked.groupBy("query_id", "block").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("query_id", "block", (F.sum("n").over(Window.partitionBy("query_id").orderBy("block")) - F.col("n")).alias("base"))


def per_query(queries: DataFrame, results: DataFrame, qrels: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, p_at_k, p_at_r, ap) for every query of queries(query_id). Without results or relevant documents a measure is 0."""
    wanted, n = qrels.select("query_id", "doc_id").distinct(), queries.count()
    hits = _counted(results.join(wanted, ["query_id", "doc_id"]).select("query_id", "rank"), n)
    sizes = qrels.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("r"))
    sums = hits.join(_small(sizes, n), "query_id").groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("at_k"),
        F.count_if(F.col("rank") <= F.col("r")).alias("at_r"),
        F.sum(F.col("upto") / F.col("rank")).alias("ap"),
        F.max("r").alias("r"),
    )
    share = lambda x, n: F.coalesce(F.when(n > 0, x / n), F.lit(0.0))
    return queries.select("query_id").distinct().join(sums, "query_id", "left").select("query_id", share(F.col("at_k"), F.lit(k)).alias("p_at_k"), share(F.col("at_r"), F.col("r")).alias("p_at_r"), share(F.col("ap"), F.col("r")).alias("ap"))


def precision_at_k(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, p_at_k); fewer than k results still divide by k, and k of 0 gives 0."""
    judged = _judged(results, qrels)
    value = F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) / k if k else F.lit(0.0)
    return judged.groupBy("query_id").agg(value.alias("p_at_k"))


def means(measures: DataFrame, digits: int = 3) -> DataFrame:
    """One row: mp_at_k, mp_at_r, map; zeros if there is no query."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits)
    return measures.agg(mean("p_at_k").alias("mp_at_k"), mean("p_at_r").alias("mp_at_r"), mean("ap").alias("map"))


def with_ranks(scored: DataFrame, n_queries: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) with rank by score descending, then id.

    A query's results are cut at SCORE_BLOCKS quantiles of their scores, so that no task sorts all of them; documents of
    one score stay together. n_queries saves counting the queries.
    """
    n = scored.select("query_id").distinct().count() if n_queries is None else n_queries
    cuts = scored.groupBy("query_id").agg(F.percentile_approx("score", [i / SCORE_BLOCKS for i in range(1, SCORE_BLOCKS)], 10_000).alias("cuts"))
    blocked = scored.join(_small(cuts, n), "query_id").withColumn("block", F.size(F.filter("cuts", lambda c: c > F.col("score")))).drop("cuts")
    inner = Window.partitionBy("query_id", "block").orderBy(F.desc("score"), "doc_id")
    ranked = blocked.withColumn("within", F.row_number().over(inner)).join(_small(_before(blocked), n), ["query_id", "block"])
    return ranked.select(*scored.columns, (F.col("base") + F.col("within")).alias("rank"))
