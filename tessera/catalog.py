"""The registered queries of the search and relational operators, with the SQL that gives the same rows.

Floats are rounded to four places on both sides, and every limit follows a total order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.tokens import keywords, normalize, prefix_distance, qgrams
from .operators import evaluation, fuzzy, inverted, relational as rel, similarity, sparql
from .plans import cost

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if oracle:
            _oracles[fn.__name__] = oracle
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEYWORDS = ["the", "that"]
SETS = {1: "the that", 2: "and of this", 3: "with from by"}

# Keyword search

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
_TF = f"tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id)"
_BM25 = f"""{_TF},
dl AS (SELECT doc_id, len({_TOKENS}) AS dl FROM documents),
c AS (SELECT count(*) AS n, avg(dl) AS avdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
post AS (SELECT tf.term, tf.doc_id, tf.tf, tf.tf * 2.75 / (1.75 * (0.25 + 0.75 * dl.dl / c.avdl) + tf.tf) * log2(c.n * 1.0 / df.df) AS score
         FROM tf JOIN dl USING (doc_id) JOIN df USING (term), c)"""


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens FROM documents")
def kw_tokens_per_doc(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(keywords(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def inv_index_stats(spark, d):
    return inverted.boolean_postings(t(spark, d, "documents"), F.col("text")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {_TF} SELECT doc_id FROM tf WHERE term IN ('the', 'that') GROUP BY doc_id HAVING count(*) = 2 ORDER BY doc_id LIMIT 3")
def boolean_and_top(spark, d):
    return inverted.boolean_search(t(spark, d, "documents"), F.col("text"), KEYWORDS).orderBy("doc_id").limit(3)


@query(f"WITH {_TF} SELECT doc_id FROM tf WHERE term IN ('the', 'that') GROUP BY doc_id HAVING count(*) = 2")
def boolean_and_postings(spark, d):
    return inverted.boolean_and(inverted.boolean_postings(t(spark, d, "documents"), F.col("text")), KEYWORDS)


def _limits(weight: str) -> str:
    return f"WITH {_TF}, c AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT term, doc_id, tf, round({weight} * log2(c.n * 1.0 / df.df), 4) AS score FROM tf JOIN df USING (term), c"


@query(_limits("1.0"))
def bm25_k_zero(spark, d):
    return inverted.bm25_postings(t(spark, d, "documents"), F.col("text"), b=0.75, k=0.0).withColumn("score", F.round("score", 4))


@query(_limits("tf.tf"))
def bm25_k_infinite(spark, d):
    return inverted.bm25_postings(t(spark, d, "documents"), F.col("text"), b=0.0, k=math.inf).withColumn("score", F.round("score", 4))


@query(f"WITH {_BM25}, s AS (SELECT doc_id, round(sum(score), 4) AS score FROM post WHERE term IN ('the', 'that') GROUP BY doc_id) SELECT doc_id, score, (SELECT count(*) FROM s) AS total FROM s ORDER BY score DESC, doc_id LIMIT 3")
def bm25_total_hits(spark, d):
    postings = inverted.bm25_postings(t(spark, d, "documents"), F.col("text"), terms=KEYWORDS)
    return inverted.search_with_total(postings, "the that", 3, digits=4, only=True)


@query(f"WITH {_BM25} SELECT term, doc_id, tf, round(score, 4) AS score FROM post")
def bm25_postings(spark, d):
    return inverted.bm25_postings(t(spark, d, "documents"), F.col("text")).withColumn("score", F.round("score", 4))


def _search(spark, d, text, **options):
    docs = t(spark, d, "documents")
    return inverted.search(inverted.bm25_postings(docs, F.col("text"), terms=inverted.keywords_of(text)), text, only=True, **options)


@query(f"WITH {_BM25} SELECT doc_id, round(sum(score), 4) AS score FROM post WHERE term IN ('the', 'that') GROUP BY doc_id ORDER BY 2 DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    return _search(spark, d, "the that", k=10, digits=4)


@query(f"WITH {_BM25} SELECT doc_id, round(sum(CASE term WHEN 'the' THEN 2 ELSE 1 END * score), 4) AS score FROM post WHERE term IN ('the', 'that') GROUP BY doc_id ORDER BY 2 DESC, doc_id LIMIT 10")
def bm25_repeated_keyword(spark, d):
    return _search(spark, d, "the that the", k=10, digits=4)


@query(f"WITH {_BM25} SELECT d.doc_id, round(coalesce(s.score, 0), 4) AS score FROM documents d LEFT JOIN (SELECT doc_id, sum(score) AS score FROM post WHERE term IN ('the', 'that') GROUP BY doc_id) s USING (doc_id)")
def td_matvec_all_docs(spark, d):
    docs = t(spark, d, "documents")
    return inverted.matrix_search(inverted.bm25_postings(docs, F.col("text"), terms=KEYWORDS), docs, "the that", only=True).withColumn("score", F.round("score", 4))


@query(f"WITH {_TF} SELECT doc_id, CAST(tf AS BIGINT) AS score FROM tf WHERE term = 'the' UNION ALL SELECT doc_id, CAST(0 AS BIGINT) FROM tf WHERE FALSE")
def term_postings(spark, d):
    return inverted.term_frequencies(t(spark, d, "documents"), F.col("text")).where("term = 'the'").select("doc_id", F.col("tf").alias("score"))


@query(f"WITH {_TF} SELECT doc_id, sum(tf) AS score FROM tf WHERE term IN ('the', 'that') GROUP BY doc_id")
def union_of_postings(spark, d):
    tf = inverted.term_frequencies(t(spark, d, "documents"), F.col("text")).select("term", "doc_id", F.col("tf").alias("score"))
    one = lambda term: tf.where(F.col("term") == term).select("doc_id", "score")
    return inverted.union_scored(one("the"), one("that"))


@query(f"WITH {_TF} SELECT doc_id FROM tf WHERE term = 'the' INTERSECT SELECT doc_id FROM tf WHERE term = 'that'")
def intersection_of_postings(spark, d):
    tf = inverted.boolean_postings(t(spark, d, "documents"), F.col("text"))
    return inverted.intersect(tf.where("term = 'the'"), tf.where("term = 'that'"))


@query(r"SELECT doc_id, regexp_replace(text, '\b(that|the)\b', '<\1>', 'gi') AS marked FROM documents WHERE regexp_matches(text, '\b(that|the)\b', 'i')")
def highlight_hits(spark, d):
    docs = t(spark, d, "documents")
    return docs.where(F.regexp_like("text", F.lit(r"(?i)\b(that|the)\b"))).select("doc_id", inverted.highlight(F.col("text"), KEYWORDS, "<", ">").alias("marked"))


# Evaluation

_EVAL = f"""{_BM25},
q(query_id, term) AS (VALUES {", ".join(f"({q}, '{w}')" for q, s in SETS.items() for w in s.split())}),
s AS (SELECT query_id, doc_id, round(sum(score), 4) AS score FROM q JOIN post USING (term) GROUP BY query_id, doc_id),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
rel AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
n AS (SELECT count(*) AS r FROM rel),
j AS (SELECT query_id, rank, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM r LEFT JOIN rel USING (doc_id)),
u AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM j),
m AS (SELECT query_id, sum(CASE WHEN rank <= 3 THEN hit ELSE 0 END) / 3.0 AS p_at_k, sum(CASE WHEN rank <= n.r THEN hit ELSE 0 END) * 1.0 / n.r AS p_at_r,
             sum(CASE WHEN hit = 1 THEN upto * 1.0 / rank ELSE 0 END) / n.r AS ap FROM u, n GROUP BY query_id, n.r)"""


def _measures(spark, d):
    docs = t(spark, d, "documents")
    terms = sorted({w for s in SETS.values() for w in s.split()})
    scored = inverted.ranked(inverted.bm25_postings(docs, F.col("text"), terms=terms), inverted.query_terms(spark, SETS)).withColumn("score", F.round("score", 4))
    results = evaluation.with_ranks(scored, len(SETS))
    numbers = spark.createDataFrame([(q,) for q in SETS], "query_id long")
    qrels = t(spark, d, "labels").where("quality = 1").select("doc_id").distinct().crossJoin(F.broadcast(numbers))  # three queries
    return numbers, results, qrels


@query(f"WITH {_EVAL} SELECT CAST(query_id AS BIGINT) AS query_id, round(p_at_k, 4) AS p_at_k FROM m")
def precision_at_k(spark, d):
    _, results, qrels = _measures(spark, d)
    return evaluation.precision_at_k(results, qrels, 3).withColumn("p_at_k", F.round("p_at_k", 4))


@query(f"WITH {_EVAL} SELECT CAST(query_id AS BIGINT) AS query_id, round(p_at_k, 4) AS p_at_k, round(p_at_r, 4) AS p_at_r, round(ap, 4) AS ap FROM m")
def average_precision(spark, d):
    found = evaluation.per_query(*_measures(spark, d))
    return found.select("query_id", *(F.round(c, 4).alias(c) for c in ("p_at_k", "p_at_r", "ap")))


@query(f"WITH {_EVAL} SELECT round(avg(p_at_k), 3) AS mp_at_k, round(avg(p_at_r), 3) AS mp_at_r, round(avg(ap), 3) AS map FROM m")
def mean_measures(spark, d):
    return evaluation.means(evaluation.per_query(*_measures(spark, d)))


@query("SELECT doc_id, CAST(len([w FOR w IN regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') IF w NOT IN (" + ", ".join(f"'{w}'" for w in evaluation.STOPWORDS) + ")]) AS BIGINT) AS n FROM documents")
def stopwords_removed(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(evaluation.without_stopwords(keywords(F.col("text")))).cast("long").alias("n"))


# Relational operators


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def project_distinct(spark, d):
    return rel.project(t(spark, d, "customer"), [2, 4], distinct=True)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE coalesce(TRY_CAST(left(CAST(o_orderdate AS VARCHAR), 4) AS INTEGER), 0) BETWEEN 1993 AND 1995 AND o_totalprice >= 100000.0 AND o_orderstatus = 'F'")
def select_cast_range(spark, d):
    orders = t(spark, d, "orders")
    year = F.coalesce(F.substring(F.col("o_orderdate").cast("string"), 1, 4).try_cast("int"), F.lit(0))
    return rel.project(rel.select(orders, year.between(1993, 1995) & (F.col("o_totalprice") >= 100000.0) & (F.col("o_orderstatus") == "F")), [0, 5])


@query("SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'S%' AND p_name LIKE '%e%'")
def prefix_contains(spark, d):
    return t(spark, d, "part").where(F.col("p_type").startswith("S") & F.col("p_name").contains("e")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON nullif(c_nationkey, 3) = n_nationkey")
def join_inner(spark, d):
    return _nations(spark, d, "inner")


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON nullif(c_nationkey, 3) = n_nationkey")
def join_left(spark, d):
    return _nations(spark, d, "left_outer")


@query("SELECT c_custkey, c_name, n_name FROM customer RIGHT JOIN nation ON nullif(c_nationkey, 3) = n_nationkey")
def join_right(spark, d):
    return _nations(spark, d, "right_outer")


def _nations(spark, d, how):
    customer = t(spark, d, "customer").select("c_custkey", "c_name", F.nullif("c_nationkey", F.lit(3)).alias("key"))
    return rel.project(rel.join(customer, t(spark, d, "nation"), 2, 0, how), [0, 1, 4])


@query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND month(l_shipdate) = month(o_orderdate)")
def join_two_key(spark, d):
    items = t(spark, d, "lineitem").select("l_orderkey", F.month("l_shipdate").alias("m"), "l_linenumber")
    orders = t(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"), "o_totalprice")
    return rel.project(rel.join(items, orders, [0, 1], [0, 1]), [0, 2, 5])


@query("SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY r_name, n_name")
def join_chain_comma(spark, d):
    customers = rel.project(rel.join(t(spark, d, "customer"), t(spark, d, "nation"), 2, 0), [0, 6, 7])
    named = rel.project(rel.join(customers, t(spark, d, "region"), 2, 0), [0, 1, 4])
    orders = rel.project(t(spark, d, "orders"), [1, 3])
    joined = rel.project(rel.join(orders, named, 0, 0), [4, 3, 0, 1])
    rounded = lambda c: F.round(rel.total(c), 2)
    return rel.group_by(joined, [0, 1], [(2, rel.count_rows), (3, rounded)]).toDF("r_name", "n_name", "n_orders", "total")


@query("SELECT r_name, n_name FROM region, nation")
def cross_join_small(spark, d):
    return rel.cross(t(spark, d, "region").select("r_name"), t(spark, d, "nation").select("n_name"))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price, max(o_totalprice) AS top_price, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def group_multi_agg(spark, d):
    price = t(spark, d, "orders").select("o_orderpriority", *(F.col("o_totalprice").alias(f"p{i}") for i in range(4)))
    rounded = lambda c: F.round(rel.total(c), 2)
    return rel.group_by(price, [0], [(1, rel.count_values), (2, rel.mean()), (3, rel.maximum), (4, rounded)]).toDF("o_orderpriority", "n", "mean_price", "top_price", "total")


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, CAST(product(1 + n_nationkey % 3) AS BIGINT) AS prod, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
def group_concat_product(spark, d):
    nation = t(spark, d, "nation").select("n_regionkey", "n_name", (1 + F.col("n_nationkey") % 3).alias("p"), "n_nationkey")
    return rel.group_by(nation, [0], [(1, rel.joined()), (2, rel.integer_product), (3, rel.integer_sum)]).toDF("n_regionkey", "names", "prod", "total")


_TOP = "SELECT c_custkey, c_name, round(avg(o_totalprice), 2) AS mean_price, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING count(*) >= 5 ORDER BY mean_price DESC, c_custkey LIMIT 10"


@query(_TOP)
def having_order_limit(spark, d):
    joined = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    grouped = joined.groupBy("c_custkey", "c_name").agg(F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.count(F.lit(1)).alias("n"))
    return grouped.where("n >= 5").orderBy(F.desc("mean_price"), "c_custkey").limit(10)


@query(_TOP)
def agg_then_lookup(spark, d):
    grouped = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return rel.top_then_lookup(grouped, [F.desc("mean_price"), F.col("c_custkey")], 10, t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT p_size // 10 AS decade, p_retailprice, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS names FROM part JOIN (SELECT p_size // 10 AS g, max(p_retailprice) AS m FROM part GROUP BY g) ON p_size // 10 = g AND p_retailprice = m GROUP BY 1, 2")
def argmax_ties(spark, d):
    part = t(spark, d, "part").select(F.expr("CAST(p_size div 10 AS INT)").alias("decade"), "p_retailprice", F.col("p_name").alias("names"))
    return rel.top_with_ties(part, ["decade"], "p_retailprice", "names")


@query("SELECT n_name, c_custkey, c_acctbal FROM (SELECT n_name, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k <= 2")
def rank_within_group(spark, d):
    joined = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rel.numbered_within(joined.select("n_name", "c_custkey", "c_acctbal"), ["n_name"], [F.desc("c_acctbal"), F.col("c_custkey")]).where("rank <= 2").drop("rank")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def membership_filter(spark, d):
    wanted = t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").join(wanted, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, k FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 20")
def order_nulls_first(spark, d):
    keyed = t(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return rel.limit(rel.order_by(keyed, 1, then=[0]), 20)


# Graph patterns

_TRIPLES = """tr AS (
SELECT c_name AS subject, 'nation' AS predicate, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_name, 'segment', c_mktsegment FROM customer
UNION ALL SELECT s_name, 'located', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 'region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def triples(spark: SparkSession, d: str) -> DataFrame:
    nation = t(spark, d, "nation")
    part = lambda df, s, p, o: df.select(F.col(s).alias("subject"), F.lit(p).alias("predicate"), F.col(o).alias("object"))
    customer, supplier = t(spark, d, "customer"), t(spark, d, "supplier")
    parts = [
        part(customer.join(nation, customer.c_nationkey == nation.n_nationkey), "c_name", "nation", "n_name"),
        part(customer, "c_name", "segment", "c_mktsegment"),
        part(supplier.join(nation, supplier.s_nationkey == nation.n_nationkey), "s_name", "located", "n_name"),
        part(nation.join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "region", "r_name"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {_TRIPLES} SELECT a.subject AS c, b.object AS r FROM tr a, tr b, tr s WHERE a.predicate = 'nation' AND b.predicate = 'region' AND a.object = b.subject AND s.subject = a.subject AND s.predicate = 'segment' AND s.object = 'BUILDING'")
def sparql_bgp(spark, d):
    return sparql.run(triples(spark, d), "SELECT ?c ?r WHERE { ?c nation ?n . ?n region ?r . ?c segment BUILDING }")


@query(f"WITH {_TRIPLES} SELECT a.subject AS c, a.object AS n FROM tr a, tr b WHERE a.predicate = 'nation' AND b.predicate = 'region' AND b.object = 'ASIA' AND a.object = b.subject ORDER BY a.object DESC, a.subject LIMIT 15")
def sparql_order_limit(spark, d):
    return sparql.run(triples(spark, d), "SELECT ?c ?n WHERE { ?c nation ?n . ?n region ASIA . } ORDER BY DESC(?n) LIMIT 15", ties=("?c",))


@query(f"WITH {_TRIPLES} SELECT a.subject AS x, b.subject AS y, a.object AS n FROM tr a, tr b, tr c, tr e WHERE a.predicate = 'nation' AND b.predicate = 'nation' AND a.object = b.object AND c.predicate = 'segment' AND e.predicate = 'segment' AND c.subject = a.subject AND e.subject = b.subject AND c.object = 'MACHINERY' AND e.object = 'HOUSEHOLD'")
def sparql_triangle(spark, d):
    return sparql.run(triples(spark, d), "SELECT ?x ?y ?n WHERE { ?x nation ?n . ?y nation ?n . ?x segment MACHINERY . ?y segment HOUSEHOLD }")


@query(f"WITH {_TRIPLES} SELECT a.subject AS n, b.object AS s FROM (SELECT DISTINCT subject, object, predicate FROM tr WHERE predicate = 'region' AND object = 'EUROPE') a, (SELECT DISTINCT object, predicate FROM tr WHERE predicate = 'region') b")
def sparql_disconnected(spark, d):
    graph = triples(spark, d).where("predicate = 'region'")
    return sparql.run(graph.unionByName(graph.select(F.lit("all").alias("subject"), F.lit("has").alias("predicate"), "object").distinct()), "SELECT ?n ?s WHERE { ?n region EUROPE . all has ?s }")


@query(
    """WITH own AS (SELECT 'nation' AS predicate, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1 UNION ALL SELECT 'segment', c_mktsegment FROM customer WHERE c_custkey = 1),
n AS (SELECT 'nation' AS predicate, count(*) AS n FROM customer UNION ALL SELECT 'segment', count(*) + 1 FROM customer)
SELECT upper(predicate) AS predicate, string_agg(DISTINCT lower(object), ', ' ORDER BY lower(object)) AS objects FROM own JOIN n USING (predicate) GROUP BY predicate"""
)
def relations_api(spark, d):
    graph = triples(spark, d).where("predicate IN ('nation', 'segment')")
    counts = graph.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    facts = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.cast("string").alias("object"))
    both = [
        graph,
        facts(counts, F.col("predicate"), "count", F.col("n") + (F.col("predicate") == "segment").cast("int")),
        facts(counts, F.col("predicate"), "label", F.upper("predicate")),
        facts(graph.select("object").distinct(), F.col("object"), "label", F.lower("object")),
    ]
    name = t(spark, d, "customer").where("c_custkey = 1").first()["c_name"]
    return sparql.relations(reduce(DataFrame.unionByName, both), name)


# Fuzzy search


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}_]+', '', 'g')) AS norm FROM part")
def normalize_names(spark, d):
    return t(spark, d, "part").select("p_partkey", normalize(F.col("p_name")).alias("norm"))


_NAMES = "nm AS (SELECT p_partkey AS syn_id, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}_]+', '', 'g')) AS w FROM part)"
_QGRAMS = f"{_NAMES}, qg AS (SELECT syn_id, substr('$$' || w, i, 3) AS qgram FROM (SELECT syn_id, w, unnest(range(1, length(w) + 1)) AS i FROM nm)), ix AS (SELECT qgram, syn_id, count(*) AS freq FROM qg GROUP BY qgram, syn_id)"


def _parts(spark, d):
    part = t(spark, d, "part")
    entities = part.select(F.col("p_partkey").alias("ent_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("score"), F.array("p_brand").alias("synonyms"), F.array("p_type").alias("info"))
    names = fuzzy.names_of(entities)
    return entities, names, fuzzy.qgram_postings(names)


@query(f"WITH {_QGRAMS} SELECT * FROM ix")
def qgram_index(spark, d):
    return _parts(spark, d)[2]


def _weights(prefix: str) -> str:
    grams = fuzzy.qgrams_of(prefix)
    return ", ".join(f"('{g}', {grams.count(g)})" for g in sorted(set(grams)))


PREFIX = "blue blt"
_NORM = fuzzy.normalized(PREFIX)
_CAND = f"{_QGRAMS}, qq(qgram, n) AS (VALUES {_weights(_NORM)}), cand AS (SELECT syn_id, CAST(sum(n * freq) AS BIGINT) AS freq FROM ix JOIN qq USING (qgram) GROUP BY syn_id)"
_DELTA = fuzzy.delta_for(_NORM)
_PED = f"list_min([levenshtein('{_NORM}', substr(w, 1, i)) FOR i IN range(0, least(length(w), {len(_NORM) + _DELTA}) + 1)])"


@query(f"WITH {_CAND} SELECT * FROM cand")
def qgram_candidates(spark, d):
    return fuzzy.candidates(_parts(spark, d)[2], _NORM)


@query(f"WITH {_NAMES} SELECT syn_id, CAST(least({_DELTA} + 1, {_PED}) AS INTEGER) AS ped FROM nm")
def ped_verify(spark, d):
    return _parts(spark, d)[1].select("syn_id", prefix_distance(F.lit(_NORM), F.col("norm_name"), _DELTA).alias("ped"))


@query(f"WITH {_CAND} SELECT syn_id AS ent_id, syn_id, CAST(ped AS INTEGER) AS ped, CAST(p_size AS BIGINT) AS score FROM (SELECT syn_id, {_PED} AS ped FROM cand JOIN nm USING (syn_id) WHERE freq >= {len(_NORM) - 3 * _DELTA}) JOIN part ON p_partkey = syn_id WHERE ped <= {_DELTA} ORDER BY ped, score DESC, ent_id LIMIT 5")
def fuzzy_topk(spark, d):
    entities, names, postings = _parts(spark, d)
    return fuzzy.find_matches(postings, names, entities, _NORM, _DELTA, k=5)


_BRAND = "brand1"


@query(
    f"""WITH every AS (SELECT p_partkey AS ent_id, 2 * row_number() OVER (ORDER BY p_partkey) - 1 AS syn_id, p_name AS name FROM part UNION ALL SELECT p_partkey, 2 * row_number() OVER (ORDER BY p_partkey), p_brand FROM part),
nm AS (SELECT ent_id, syn_id, lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS w FROM every),
near AS (SELECT ent_id, syn_id, list_min([levenshtein('{_BRAND}', substr(w, 1, i)) FOR i IN range(0, least(length(w), 7) + 1)]) AS ped FROM nm),
best AS (SELECT ent_id, syn_id, ped, row_number() OVER (PARTITION BY ent_id ORDER BY ped, syn_id) AS k FROM near WHERE ped <= 1)
SELECT ent_id, syn_id, CAST(ped AS INTEGER) AS ped, CAST(p_size AS BIGINT) AS score FROM best JOIN part ON p_partkey = ent_id WHERE k = 1 ORDER BY ped, score DESC, ent_id LIMIT 20"""
)
def fuzzy_synonyms(spark, d):
    entities, _, _ = _parts(spark, d)
    names = fuzzy.names_of(entities, synonyms=True)
    return fuzzy.find_matches(fuzzy.qgram_postings(names), names, entities, _BRAND, 1, k=20)


@query("SELECT CAST(p_partkey AS BIGINT) AS syn_id, p_name AS synonym, p_name AS name, CAST(p_size AS BIGINT) AS score, p_type AS info FROM part WHERE p_partkey = 7")
def entity_infos(spark, d):
    entities, names, _ = _parts(spark, d)
    return fuzzy.infos(entities, names, 7).withColumn("info", F.array_join("info", ", "))


# Vectors

_DOT = "list_sum([CAST(e[i] AS DOUBLE) * CAST(q[i] AS DOUBLE) FOR i IN range(1, len(e) + 1)])"


@query(
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[])))) AS sim FROM embeddings, q)
SELECT vec_id, round(sim, 4) AS sim FROM s ORDER BY 2 DESC, vec_id LIMIT 10"""
)
def cosine_topk(spark, d):
    vectors = t(spark, d, "embeddings")
    return similarity.top_k(vectors, list(vectors.where("vec_id = 0").first()["embedding"]), 10, "vec_id", "embedding", digits=4)


TOKEN_VECTORS = [("The", [1.0, 0.5]), ("the", [0.5, -1.0]), ("and", [-2.0, 1.5]), ("de", [0.25, 3.0])]


@query(
    "WITH v(token, a, b) AS (VALUES " + ", ".join(f"('{w}', {a}, {b})" for w, (a, b) in TOKEN_VECTORS) + """),
tok AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+(?:[''-][\\p{L}\\p{N}_]+)*')) AS token FROM documents),
s AS (SELECT doc_id, sum(a) AS a, sum(b) AS b FROM tok JOIN v USING (token) GROUP BY doc_id)
SELECT doc_id, round(CAST(coalesce(a, 0) AS DOUBLE), 4) AS v0, round(CAST(coalesce(b, 0) AS DOUBLE), 4) AS v1 FROM documents LEFT JOIN s USING (doc_id)"""
)
def embed_documents(spark, d):
    vectors = spark.createDataFrame(TOKEN_VECTORS, "token string, vec array<float>")
    made = similarity.embed_documents(t(spark, d, "documents"), vectors, 2)
    return made.select("doc_id", F.round(F.col("vec")[0], 4).alias("v0"), F.round(F.col("vec")[1], 4).alias("v1"))


# Cost model


@query(
    """WITH n(m, mk, a, ak) AS (VALUES (1000, 4, 20, 2))
SELECT 'filter_first' AS plan, CAST(a * ak + m * 3 + a / 2 + m + a / 2 * (3 + ak) + a / 2 * 2 AS DOUBLE) AS cost, CAST(a / 2 AS DOUBLE) AS n_rows, CAST(2 AS BIGINT) AS n_columns FROM n
UNION ALL SELECT 'join_first', CAST(m * 3 + m * 2 + m + a + a * (2 + ak) + a * (2 + ak) + a / 2 * 2 AS DOUBLE), CAST(a / 2 AS DOUBLE), CAST(2 AS BIGINT) FROM n"""
)
def cost_model(spark, d):
    movies, awards = cost.Shape(1000, 4), cost.Shape(20, 2)
    first = awards.select().join(movies.project(3)).project(2)
    second = movies.project(3).project(2).join(awards).select().project(2)
    rows = [(name, float(s.cost), float(s.rows), s.columns) for name, s in (("filter_first", first), ("join_first", second))]
    return spark.createDataFrame(rows, "plan string, cost double, n_rows double, n_columns long")


from . import catalog_parts  # noqa: E402, F401  the queries of sources, sinks, requests and single operators
