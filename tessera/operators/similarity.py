"""Vector search: summed token embeddings and cosine neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tokens import words
from ..functions.vectors import cosine

#: Token tables up to this many rows are broadcast.
BROADCAST_TOKENS = 200_000
#: Query vectors up to this many are broadcast.
BROADCAST_QUERIES = 10_000


def embed_documents(docs: DataFrame, vectors: DataFrame, dim: int, doc_id: str = "doc_id", text_col: str = "text", by_spaces: bool = False, n_vectors: int | None = None) -> DataFrame:
    """(doc_id, vec array<double>): the sum of the tokens' vectors, unknown tokens and empty documents giving zeros.

    A small token table is joined right behind the tokens, so that only sums of known tokens are shuffled, once; for a
    large one tokens are counted first. The sums are dim aggregates of one grouping.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.split(text, " ") if by_spaces else words(text)).alias("token"))
    if (vectors.count() if n_vectors is None else n_vectors) <= BROADCAST_TOKENS:
        known = tokens.join(F.broadcast(vectors), "token").withColumn("n", F.lit(1))
    else:
        known = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")).join(vectors, "token")
    sums = known.groupBy("doc_id").agg(*(F.sum(F.col("n") * F.col("vec")[i].cast("double")).alias(f"v{i}") for i in range(dim)))
    zero = F.array(*(F.lit(0.0) for _ in range(dim)))
    made = sums.select("doc_id", F.array(*(f"v{i}" for i in range(dim))).alias("vec"))
    return docs.select(F.col(doc_id).alias("doc_id")).join(made, "doc_id", "left").select("doc_id", F.coalesce("vec", zero).alias("vec"))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "doc_id", vec_col: str = "vec", digits: int | None = None) -> DataFrame:
    """(id, sim): the k nearest by cosine, then id. The query is a literal; every partition keeps k rows at most."""
    sim = cosine(F.col(vec_col), F.array(*(F.lit(float(x)) for x in query)))
    sim = F.round(sim, digits) if digits is not None else sim
    return vectors.select(id_col, sim.alias("sim")).orderBy(F.desc("sim"), id_col).limit(k)


def top_k_of_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "vec", blocks: int = 64) -> DataFrame:
    """(query_id, id, sim, rank) for queries(query_id, qvec), broadcast while few. Each block of rows keeps its k nearest before they meet."""
    queries = F.broadcast(queries) if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else queries
    pairs = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block")).crossJoin(queries)
    scored = pairs.select("query_id", "id", "block", cosine(F.col("v"), F.col("qvec")).alias("sim"))
    inner = Window.partitionBy("query_id", "block").orderBy(F.desc("sim"), "id")
    outer = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    kept = scored.withColumn("at", F.row_number().over(inner)).where(F.col("at") <= k)
    return kept.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= k).select("query_id", "id", "sim", "rank")
