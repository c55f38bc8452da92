"""Inverted indexes and keyword search.

postings(term, doc_id, tf, score) is both the inverted lists and the sparse term-document matrix. Query sides are small and
broadcast; the index is built by one shuffle of its counts, which are combined before it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.tokens import keywords

#: Query terms up to this many are broadcast.
BROADCAST_TERMS = 200_000


def keywords_of(query: str) -> list[str]:
    return re.findall("[a-z]+", query.lower())


def doc_text(*columns: str) -> Column:
    return F.concat_ws(" ", *columns)


def boolean_postings(docs: DataFrame, text: Column, doc_id: str = "doc_id") -> DataFrame:
    """(term, doc_id), each once."""
    return docs.select(F.explode(F.array_distinct(keywords(text))).alias("term"), F.col(doc_id).alias("doc_id"))


def boolean_search(docs: DataFrame, text: Column, terms: list[str], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id) of documents that hold every term, by one scan without a shuffle. No terms give none."""
    found = docs.select(F.col(doc_id).alias("doc_id"), keywords(text).alias("tokens"))
    if not terms:
        return found.select("doc_id").limit(0)
    for term in sorted(set(terms)):
        found = found.where(F.array_contains("tokens", term))
    return found.select("doc_id")


def boolean_and(postings: DataFrame, terms: list[str], exact: bool = True) -> DataFrame:
    """(doc_id) of documents that hold every term. No terms, or an unknown one, give none. exact: (term, doc_id) are distinct."""
    wanted = sorted(set(terms))
    hits = postings.where(F.col("term").isin(wanted)) if wanted else postings.limit(0)
    counted = F.count(F.lit(1)) if exact else F.count_distinct("term")
    return hits.groupBy("doc_id").agg(counted.alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def term_frequencies(docs: DataFrame, text: Column, doc_id: str = "doc_id") -> DataFrame:
    """(term, doc_id, tf)."""
    return docs.select(F.explode(keywords(text)).alias("term"), F.col(doc_id).alias("doc_id")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def _counted(tokens: Column) -> Column:
    """[(term, tf)] of an array of tokens, then a null term: the runs of the sorted tokens, linear after the sort."""
    # a place outside the array is null, so the first token and the end differ from what is before them; lambdas bind what is made once
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    runs = lambda s, at: F.transform(at, lambda i, n: F.struct(F.get(s, i).alias("term"), (F.get(at, n + 1) - i).cast("long").alias("tf")))
    return F.transform(F.array(F.sort_array(tokens)), lambda s: F.transform(F.array(starts(s)), lambda at: runs(s, at))[0])[0]


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _weight(tf: Column, alpha: Column, k: float) -> Column:
    """tf * (k + 1) / (k * alpha + tf), and its limits for k of 0 and infinity."""
    if k == 0:
        return F.lit(1.0)
    return tf / alpha if math.isinf(k) else tf * (k + 1) / (k * alpha + tf)


def bm25_postings(docs: DataFrame, text: Column, doc_id: str = "doc_id", b: float = 0.75, k: float = 1.75, terms: list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf, score). With terms, only their postings are made; the figures are those of the whole corpus.

    Without terms the documents are counted first. Where no id repeats, a document's terms are counted in its row, and their
    postings are shuffled once, by term. Otherwise the documents are read once: beside its terms each one enters the counts
    under the empty term, whose rows give the number and the mean length of documents.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), keywords(text).alias("tokens")).select("doc_id", "tokens", F.size("tokens").alias("dl"))
    if terms is None:
        dl = F.col("dl") if b and k else F.lit(0)  # lengths don't enter otherwise, so texts aren't read for them
        ids = sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(dl).alias("dl"))
        most, n, total = ids.agg(F.max("rows"), F.sum("rows"), F.sum("dl")).first()  # type: ignore[misc]
        if (most or 0) <= 1:
            tf = sized.select("doc_id", "dl", F.explode(_counted(F.col("tokens"))).alias("one")).select("one.term", "doc_id", "one.tf", "dl").where("term is not null")
            found = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))
            return _scored(found.withColumns({"n": F.lit(n or 0), "avdl": F.lit((total or 0) / (n or 1))}), b, k)
    tokens = "tokens"
    if terms is not None:
        wanted = F.array(*(F.lit(t) for t in sorted(set(terms)))) if terms else F.array().cast("array<string>")
        sized, tokens = sized.withColumn("own", F.filter("tokens", lambda t: F.array_contains(wanted, t))), "own"
    tf = sized.select("doc_id", "dl", F.explode(F.concat(tokens, F.array(F.lit("")))).alias("term")).where("term is not null")
    tf = tf.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    # conditions and sums that need both a key and a count stay above the exchange, so that all three uses share it
    is_term, rows = F.col("tf") + F.length("term") > F.col("tf"), F.coalesce(F.sum(F.when(F.col("tf") > 0, 1)), F.lit(0))
    corpus = tf.where(~is_term).agg(rows.alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avdl"))
    df = tf.where(is_term).groupBy("term").agg(rows.alias("df"))
    return _scored(tf.where(is_term).join(df, "term").crossJoin(F.broadcast(corpus)), b, k)  # corpus is one row


def _scored(counts: DataFrame, b: float, k: float) -> DataFrame:
    """(term, doc_id, tf, score) of counts(term, doc_id, tf, dl, df, n, avdl)."""
    alpha = 1 - b + b * F.col("dl") / F.col("avdl") if b and k else F.lit(1.0)
    return counts.select("term", "doc_id", "tf", (_weight(F.col("tf"), alpha, k) * F.log2(F.col("n") / F.col("df"))).alias("score"))


def query_terms(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """(query_id, term, qtf): the bag of keywords of each query."""
    rows = [(q, t, n) for q, text in queries.items() for t, n in Counter(keywords_of(text)).items()]
    return spark.createDataFrame(rows, "query_id long, term string, qtf long")


def ranked(postings: DataFrame, terms: DataFrame, n_terms: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): summed over the bag of query terms, documents with a term only."""
    small = F.broadcast(terms) if (terms.count() if n_terms is None else n_terms) <= BROADCAST_TERMS else terms
    return postings.join(small, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("score")).alias("score"))


def search(postings: DataFrame, query: str, k: int | None = None, digits: int | None = None, only: bool = False) -> DataFrame:
    """(doc_id, score) by score descending, then id. k of None keeps all. only: postings hold no other terms than the query's."""
    bag = Counter(keywords_of(query))
    if not bag:
        return postings.select("doc_id", "score").limit(0)
    weight = F.lit(0)
    for term, n in sorted(bag.items()):
        weight = F.when(F.col("term") == term, F.lit(n)).otherwise(weight)
    found = (postings if only else postings.where(F.col("term").isin(list(bag)))).groupBy("doc_id").agg(F.sum(weight * F.col("score")).alias("score"))
    if digits is not None:
        found = found.withColumn("score", F.round("score", digits))
    found = found.orderBy(F.desc("score"), "doc_id")
    return found if k is None else found.limit(k)


def search_with_total(postings: DataFrame, query: str, k: int, digits: int | None = None, only: bool = False) -> DataFrame:
    """The first k rows of search with total, the number of all documents found."""
    found = search(postings, query, digits=digits, only=only)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.limit(k).crossJoin(F.broadcast(total)).orderBy(F.desc("score"), "doc_id")  # total is one row


def matrix_search(postings: DataFrame, docs: DataFrame, query: str, doc_id: str = "doc_id", only: bool = False) -> DataFrame:
    """As search, with every document: those without a term score 0."""
    return docs.select(F.col(doc_id).alias("doc_id")).join(search(postings, query, only=only), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "doc_id")


def union_scored(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two lists (doc_id, score) with scores of shared documents summed."""
    return a.unionByName(b).groupBy("doc_id").agg(F.sum("score").alias("score"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def highlight(text: Column, terms: list[str], before: str = "\033[1;31m", after: str = "\033[0m") -> Column:
    """Whole words among terms, in any case, between the marks."""
    if not terms:
        return text
    some = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?i)\b({some})\b", f"{before}$1{after}")


def fetch(found: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The found documents' rows; the found side is limited, so it is the broadcast one when small."""
    return found.join(docs.withColumnRenamed(doc_id, "doc_id"), "doc_id")
