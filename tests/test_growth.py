"""Steps whose tasks must not grow with the input: joins of few keys, and indexes counted without shuffling their entries."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import fuzzy, inverted, relational as rel, sparql


def rows(df):
    return Counter(map(tuple, df.collect()))


def longest(df):
    """The most rows that one partition of df holds, and the number of partitions."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes), df.rdd.getNumPartitions()


def test_join_many_deals_out_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(rel, "PAIRS_A_TASK", 400)
    left = spark.createDataFrame([(i, 1 if i < 200 else i, "a") for i in range(230)] + [(None, None, "a")] * 3 + [(0, 1, "a")], "id int, k int, m string")
    right = spark.createDataFrame([(i, 1 if i < 150 else i, "a" if i % 3 else "b") for i in range(230)] + [(None, None, "b")], "id int, k int, m string")
    made = rel.join_many(left, right, 1, 1)
    assert made.columns == ["id", "k", "m"] * 2
    assert rows(made) == rows(rel.join(left, right, 1, 1))
    most, n = longest(made.toDF(*"abcdef"))
    assert n >= 75 and most <= 4000  # 30,150 pairs of one key: one task had them all
    same = rel.with_unique_names(made)
    assert rows(rel.select(same, rel.column(same, 2) == rel.column(same, 5))) == rows(rel.join(left, right, [1, 2], [1, 2]))
    assert rows(rel.join_many(left, right.where("k > 1000"), 1, 1)) == Counter()
    monkeypatch.setattr(rel, "PAIRS_A_TASK", 10**9)
    assert rows(rel.join_many(left, right, 1, 1)) == rows(made)


def test_restricting_patterns_come_before_pairs(spark, monkeypatch):
    facts = [(f"s{i}", "nation", f"n{i % 2}") for i in range(60)] + [(f"s{i}", "segment", f"g{i % 5}") for i in range(60)]
    graph = spark.createDataFrame(facts + facts[:3], "subject string, predicate string, object string")
    joined = []
    original = rel.join_many
    monkeypatch.setattr(rel, "PAIRS_A_TASK", 16)
    monkeypatch.setattr(rel, "join_many", lambda a, b, *on: joined.append((a.count(), b.count())) or original(a, b, *on))
    query = sparql.parse("SELECT ?x ?y ?n WHERE { ?x nation ?n . ?y nation ?n . ?x segment g1 . ?y segment g2 }")
    found = sparql.run(graph, query)
    graph.createOrReplaceTempView("triples")
    assert rows(found) == rows(spark.sql(sparql.to_sql(query)))
    assert len(joined) == 1 and max(joined[0]) <= 20  # not with all 63 subjects of the nations


def test_equal_columns_are_dealt_out(spark, monkeypatch):
    """one task made all pairs of a small customer and supplier table."""
    d = "/root/testdata/sf0.001"
    plain = rows(catalog.queries()["equal_columns_after_join"](spark, d))
    monkeypatch.setattr(rel, "PAIRS_A_TASK", 10)
    dealt = catalog.queries()["equal_columns_after_join"](spark, d)
    assert rows(dealt) == plain and dealt.rdd.getNumPartitions() >= 4  # one file, one task


def test_qgrams_are_counted_in_parts(spark, monkeypatch):
    """one task counted the q-grams of all names of a file, and their entries were shuffled."""
    names = spark.createDataFrame([(i % 290, f"name{i}name") for i in range(300)] + [(7, "name7name"), (8, ""), (9, None)], "syn_id long, norm_name string").coalesce(1)
    want = Counter((g, r["syn_id"]) for r in names.collect() for g in fuzzy.qgrams_of(r["norm_name"] or ""))
    monkeypatch.setattr(fuzzy, "CHARS_A_TASK", 100)
    made = fuzzy.qgram_postings(names)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # that of the names only
    assert {(g, i): n for g, i, n in map(tuple, made.collect())} == dict(want)
    most, n = longest(made)
    assert n >= 25 and most <= 1000  # of about 3,000


def test_postings_are_shuffled_once(spark):
    """F4 to F6: postings were shuffled by term and document, then by term."""
    texts = ["b a b", "", None, "c B, a-b c", "Ab ab AB ça", "zz " * 50 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    repeated = docs.unionByName(docs.limit(1).withColumn("text", F.lit("x y z")))  # (doc_id, length) repeats
    for b, k in ((0.75, 1.75), (0.0, math.inf), (0.75, 0.0), (0.5, 1.0)):
        made = inverted.bm25_postings(docs, F.col("text"), b=b, k=k)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
        tf = {(i, w): n for i, x in enumerate(texts) for w, n in Counter(re.findall("[a-z]+", (x or "").lower())).items()}
        df, dl = Counter(w for _, w in tf), [len(re.findall("[a-z]+", (x or "").lower())) for x in texts]
        got = {(r["doc_id"], r["term"]): (r["tf"], r["score"]) for r in made.collect()}
        assert {key: n for key, (n, _) in got.items()} == tf
        for (i, w), (n, score) in got.items():
            alpha = 1 - b + b * dl[i] / (sum(dl) / len(dl))
            weight = 1.0 if k == 0 else n / alpha if math.isinf(k) else n * (k + 1) / (k * alpha + n)
            assert math.isclose(score, weight * math.log2(len(texts) / df[w]), abs_tol=1e-12)
    assert {(r["term"], r["tf"]) for r in inverted.bm25_postings(repeated, F.col("text")).where("doc_id = 0").collect()} == {("a", 1), ("b", 2), ("x", 1), ("y", 1), ("z", 1)}
    again = inverted.bm25_postings(docs.unionByName(docs), F.col("text")).where("doc_id = 0")
    assert {(r["term"], r["tf"]) for r in again.collect()} == {("a", 2), ("b", 4)}  # rows of one id count together
