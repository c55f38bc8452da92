"""Registered queries of sources and sinks, requests, and operators that no query of `catalog` shows alone.

What a source reads is first written in its format to a fresh path of the shared folder, from the tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import _CAND, _DELTA, _NORM, _PED, _TRIPLES, PREFIX, TOKEN_VECTORS, _parts, query, t, triples
from .operators import fuzzy, inverted, relational as rel, sparql
from .plans import api, cost
from .sources import readers, writers
from .sources.scratch import fresh_path

# Sources and sinks


def _tsv(df: DataFrame, header: bool = False) -> str:
    path = fresh_path(df.sparkSession, "tsv")
    df.write.options(**readers.TSV, header=header, nullValue="", emptyValue="").csv(path)
    return path


def _lines(df: DataFrame, order: str, head: str | None = None) -> str:
    """One file with a line for each row in order; line numbers are the format's ids, so it is one file."""
    path = fresh_path(df.sparkSession, "lines")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c != order]
    lines = df.select(F.col(order).alias("at"), F.concat_ws("\t", *fields).alias("value"))
    if head is not None:
        lines = lines.unionByName(df.sparkSession.createDataFrame([(head,)], "value string").select(F.lit(-1).alias("at"), "value"))
    lines.orderBy("at").select("value").coalesce(1).write.text(path)
    return path


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def tsv_table(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").cast("string"), F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("c_name"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return readers.table_tsv(spark, _tsv(rows, header=True))


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS doc_id, p_name AS title, p_type AS description, p_size AS num_ratings, p_retailprice AS rating, CAST(p_partkey AS INTEGER) AS num_sitelinks FROM part")
def tsv_documents(spark, d):
    part = t(spark, d, "part").select(F.col("p_partkey").alias("at"), "p_name", "p_type", "p_size", "p_retailprice", "p_partkey")
    return readers.documents_tsv(spark, _lines(part, "at"))


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS ent_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS score, 'S' || s_suppkey || '|x' AS synonyms, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal || '|' || s_nationkey ELSE '' || s_acctbal END AS info FROM supplier")
def tsv_entities(spark, d):
    supplier = t(spark, d, "supplier").select(F.col("s_suppkey").alias("at"), "s_name", "s_nationkey", F.concat(F.lit("S"), "s_suppkey", F.lit(";;x")).alias("synonyms"), F.concat_ws("\t", F.col("s_acctbal").cast("string"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey").cast("string"))).alias("info"))
    found = readers.entities_tsv(spark, _lines(supplier, "at", "name\tscore\tsynonyms\tinfo"))
    return found.withColumns({"synonyms": F.array_join("synonyms", "|"), "info": F.array_join("info", "|")})


@query("SELECT query_id, r_name AS text, CAST(n_nationkey AS BIGINT) AS doc_id FROM (SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS query_id, r_regionkey, r_name FROM region) JOIN nation ON n_regionkey = r_regionkey")
def tsv_qrels(spark, d):
    nations = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")), " ").alias("ids"))
    rows = t(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("at"), "r_name", "ids")
    queries, qrels = readers.qrels_tsv(spark, _lines(rows, "at"))
    return queries.join(qrels, "query_id")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day FROM orders GROUP BY o_orderstatus")
def typed_import(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date"))
    readers.typed_tsv(spark, _tsv(rows), "o_orderkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate DATE", "imported_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(min(o_orderdate) AS STRING) AS first_day FROM imported_orders GROUP BY o_orderstatus")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def untyped_import(spark, d):
    return readers.untyped_tsv(spark, _tsv(t(spark, d, "nation").select("n_nationkey", "n_name")), ["key", "name"])


@query(f"WITH {_TRIPLES} SELECT predicate, count(*) AS n, count(DISTINCT object) AS n_objects FROM (SELECT * FROM tr UNION ALL SELECT * FROM tr WHERE predicate = 'region') GROUP BY predicate")
def triples_of_files(spark, d):
    graph = triples(spark, d)
    loaded = readers.triples_tsv(spark, _tsv(graph), _tsv(graph.where("predicate = 'region'")))
    return loaded.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("object").alias("n_objects"))


_STATISTICS = " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, min({c}) AS low, max({c}) AS high FROM tr" for c in sparql.PARTS)


@query(f"WITH {_TRIPLES} {_STATISTICS}")
def triple_statistics(spark, d):
    path = fresh_path(spark, "triples")
    writers.write_triples(triples(spark, d), path)
    return writers.statistics(spark.read.parquet(path))


@query(f"WITH {_TRIPLES} SELECT a.subject AS c, a.object AS n FROM tr a JOIN tr b ON a.object = b.subject WHERE a.predicate = 'nation' AND b.predicate = 'region' AND b.object = 'ASIA'")
def sparql_file_as_sql(spark, d):
    path = fresh_path(spark, "query")
    spark.createDataFrame([("PREFIX x: <http://example.org/>\nSELECT ?c ?n WHERE {\n?c nation ?n .\n?n region ASIA .\n}",)], "value string").coalesce(1).write.text(path)
    sql = sparql.to_sql(sparql.parse(readers.sparql_file(spark, path)), "facts")
    return readers.run_sql(spark, sql, facts=triples(spark, d))


@query(f"WITH {_TRIPLES}, t2 AS (SELECT * FROM tr UNION ALL SELECT object, 'same', object FROM tr WHERE predicate = 'region') SELECT subject AS x FROM t2 WHERE subject = object AND predicate = 'same'")
def sparql_repeated_variable(spark, d):
    graph = triples(spark, d)
    loops = graph.where("predicate = 'region'").select(F.col("object").alias("subject"), F.lit("same").alias("predicate"), "object")
    return sparql.run(graph.unionByName(loops), "SELECT ?x WHERE { ?x same ?x }")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', {len(v)}, CAST({v[0]} AS DOUBLE))" for w, v in TOKEN_VECTORS) + ") v(token, n, first)")
def token_vectors_loaded(spark, d):
    path = fresh_path(spark, "vectors")
    spark.createDataFrame(TOKEN_VECTORS, "token string, vec array<float>").write.parquet(path)
    return readers.token_vectors(spark, path).select("token", F.size("vec").alias("n"), F.col("vec")[0].cast("double").alias("first"))


_NATION_TF = "tok AS (SELECT n_nationkey AS doc_id, unnest(regexp_extract_all(lower(n_name || ' ' || r_name), '[a-z]+')) AS term FROM nation JOIN region ON n_regionkey = r_regionkey), tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id)"


@query(f"WITH {_NATION_TF} SELECT term, doc_id, tf FROM tf WHERE term >= 'b'")
def index_written_and_read(spark, d):
    docs = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("n_nationkey", "doc_id")
    path = fresh_path(spark, "index")
    writers.write_index(inverted.bm25_postings(docs, inverted.doc_text("n_name", "r_name")), path)
    return readers.read_index(spark, path).where("term >= 'b'").select("term", "doc_id", "tf")


@query("SELECT o_orderstatus, count(*) AS n, 1 AS run FROM orders GROUP BY o_orderstatus UNION ALL SELECT o_orderstatus, count(*), 2 FROM orders GROUP BY o_orderstatus")
def report_appended(spark, d):
    path = fresh_path(spark, "report")
    counts = t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    for run in (1, 2):
        writers.append_report(counts.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path)


@query(
    """WITH r AS (SELECT CAST(r_regionkey AS VARCHAR) AS a, coalesce(nullif(r_name, 'ASIA'), '?') AS b FROM region),
x AS (SELECT a, CASE WHEN length(b) <= 6 THEN b ELSE left(b, 3) || '...' END AS b, row_number() OVER (ORDER BY a) + 2 AS line FROM r),
w AS (SELECT greatest(1, max(length(a))) AS wa, greatest(4, max(length(b))) AS wb FROM x)
SELECT line, '| ' || rpad(a, CAST(wa AS INTEGER), ' ') || ' | ' || rpad(b, CAST(wb AS INTEGER), ' ') || ' |' AS shown FROM x, w
UNION ALL SELECT 1, '| ' || rpad('k', CAST(wa AS INTEGER), ' ') || ' | ' || rpad('name', CAST(wb AS INTEGER), ' ') || ' |' FROM w
UNION ALL SELECT 2, '|' || repeat('-', wa + 2) || '|' || repeat('-', wb + 2) || '|' FROM w"""
)
def console_table(spark, d):
    rows = t(spark, d, "region").orderBy("r_regionkey").select(F.col("r_regionkey").alias("k"), F.nullif("r_name", F.lit("ASIA")).alias("name"))
    text = writers.shown(rows, width=6)
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"), 1)], "line long, shown string")


@query("SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns FROM orders JOIN (SELECT n_nationkey, n_name FROM nation) ON o_custkey = n_nationkey")
def table_shape(spark, d):
    joined = rel.join(t(spark, d, "orders"), rel.project(t(spark, d, "nation"), [0, 1]), 1, 0)
    return spark.createDataFrame([writers.shape(joined)], "n_rows long, n_columns long")


# Requests


def _index(spark: SparkSession, d: str) -> api.Index:
    return api.Index(*_parts(spark, d), triples(spark, d))


_MATCHES = f"{_CAND}, near AS (SELECT syn_id, {_PED} AS ped FROM cand JOIN nm USING (syn_id) WHERE freq >= {len(_NORM) - 3 * _DELTA}), hit AS (SELECT * FROM near WHERE ped <= {_DELTA})"


@query(f"WITH {_MATCHES} SELECT CAST(row_number() OVER (ORDER BY ped, p_size DESC, syn_id) AS BIGINT) AS place, p_name AS name, CAST(p_size AS BIGINT) AS score, p_type AS wikidata_id, (SELECT count(*) FROM hit) AS total FROM hit JOIN part ON p_partkey = syn_id ORDER BY place LIMIT 5")
def http_search(spark, d):
    status, body = api.respond(_index(spark, d), "GET", "/api/search?q=" + PREFIX.replace(" ", "%20"))
    assert status == 200
    found = json.loads(body)
    rows = [(i, r["name"], r["score"], r["wikidata_id"], found["total"]) for i, r in enumerate(found["results"], 1)]
    return spark.createDataFrame(rows, "place long, name string, score long, wikidata_id string, total long")


@query("SELECT 'is in' AS predicate, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def http_relations(spark, d):
    graph = triples(spark, d)
    facts = spark.createDataFrame([("nation", "label", "is in"), ("nation", "count", "7")], "subject string, predicate string, object string")
    names = t(spark, d, "nation").select(F.col("n_name").alias("subject"), F.lit("label").alias("predicate"), F.col("n_name").alias("object"))
    name = t(spark, d, "customer").where("c_custkey = 1").first()["c_name"]
    index = api.Index(*_parts(spark, d), graph.unionByName(facts).unionByName(names))
    status, body = api.respond(index, "GET", "/api/relations?id=" + name.replace("#", "%23"))
    assert status == 200
    return spark.createDataFrame([(r["predicate"], r["object"]) for r in json.loads(body)], "predicate string, object string")


@query("SELECT * FROM (VALUES ('POST', '/api/search?q=a', CAST(405 AS BIGINT)), ('GET', '/none', 404), ('GET', '/../secret', 403), ('GET', '/%2e%2e/secret', 403), ('GET', '/api/search', 404)) v(method, target, status)")
def http_status(spark, d):
    index = _index(spark, d)
    asked = [("POST", "/api/search?q=a"), ("GET", "/none"), ("GET", "/../secret"), ("GET", "/%2e%2e/secret"), ("GET", "/api/search")]
    return spark.createDataFrame([(m, path, api.respond(index, m, path)[0]) for m, path in asked], "method string, target string, status long")


@query(f"WITH {_MATCHES} SELECT (SELECT count(*) FROM (SELECT DISTINCT qgram FROM ix JOIN qq USING (qgram))) AS lists, (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM near) AS distances, (SELECT count(*) FROM hit) AS matches")
def fuzzy_statistics(spark, d):
    _, names, postings = _parts(spark, d)
    return fuzzy.match_stats(postings, names, _NORM, _DELTA)


_VECTOR = "[CAST(p_size AS DOUBLE), p_retailprice / 100, CAST(p_partkey % 7 AS DOUBLE)]"


@query(
    f"""WITH {_MATCHES}, best AS (SELECT syn_id FROM hit JOIN part ON p_partkey = syn_id ORDER BY ped, p_size DESC, syn_id LIMIT 1),
v AS (SELECT p_partkey AS ent_id, {_VECTOR} AS v FROM part), q AS (SELECT v AS q FROM v JOIN best ON ent_id = syn_id)
SELECT ent_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 4) AS sim FROM v, q ORDER BY sim DESC, ent_id LIMIT 6"""
)
def title_neighbours(spark, d):
    vectors = t(spark, d, "part").select(F.col("p_partkey").alias("ent_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, (F.col("p_partkey") % 7).cast("double")).alias("vec"))
    return api.similar_documents(_index(spark, d), vectors, PREFIX, 5, digits=4)


# Single operators


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 7 = 3 AND c_acctbal > 0")
def row_predicate(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rel.project(rel.select_rows(rows, lambda r: r[0] % 7 == 3 and r[2] > 0), [0, 1])


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey % 10 = s_suppkey % 10")
def equal_columns_after_join(spark, d):
    customer = t(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 10).alias("m"))
    supplier = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 10).alias("m"))
    joined = rel.with_unique_names(rel.join_many(customer, supplier, 1, 1))
    return rel.project(rel.select(joined, rel.column(joined, 2) == rel.column(joined, 5)), [0, 3])


@query("SELECT c_custkey AS id, c_name AS label FROM customer")
def renamed_columns(spark, d):
    return rel.rename(rel.project(t(spark, d, "customer"), [0, 1]), ["id", "label"])


@query("SELECT DISTINCT r_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_chain_projected(spark, d):
    orders = rel.project(rel.join(t(spark, d, "orders"), t(spark, d, "customer"), 1, 0), [2, 8])
    nations = rel.project(rel.join(orders, t(spark, d, "nation"), 1, 0), [0, 4])
    return rel.project(rel.join(nations, t(spark, d, "region"), 1, 0), [3, 0], distinct=True)


@query("SELECT p_brand, max(p_retailprice) AS p_retailprice, (SELECT min(p_name) FROM part b WHERE b.p_brand = a.p_brand AND b.p_retailprice = max(a.p_retailprice)) AS p_name FROM part a GROUP BY p_brand")
def max_with_one_label(spark, d):
    return rel.top_with_one(t(spark, d, "part").select("p_brand", "p_retailprice", "p_name"), ["p_brand"], "p_retailprice", "p_name")


@query("SELECT c_mktsegment, CAST(max(c_nationkey) - min(c_nationkey) AS BIGINT) AS c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY c_mktsegment")
def opaque_aggregate(spark, d):
    customer = t(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_acctbal")
    return rel.group_by(customer, [0], [(1, rel.opaque(lambda v: int(v.max() - v.min()), "long")), (2, rel.opaque(lambda v: round(float(v.sum()), 2), "double"))])


@query("SELECT TRUE AS reordered, FALSE AS without_repeats, FALSE AS shorter")
def bag_equality(spark, d):
    orders = t(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    checks = (orders.orderBy("o_orderpriority"), orders.distinct(), orders.where("o_orderstatus <> 'F'"))
    return spark.createDataFrame([tuple(rel.same_bag(orders, x) for x in checks)], "reordered boolean, without_repeats boolean, shorter boolean")


@query("WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM customer) AS c) SELECT round((o * 6.0 + o / 2 + c + c * (6 + 5)) / (o + c + c * (6.0 + 5) + c * (6 + 5)), 6) AS ratio FROM n")
def cost_ratio(spark, d):
    orders, customers = cost.shape_of(t(spark, d, "orders")), cost.shape_of(t(spark, d, "customer"))
    ratio = cost.ratio(orders.select().join(customers), orders.join(customers).select())
    return spark.createDataFrame([(round(ratio, 6),)], "ratio double")
