import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions.tokens import normalize, prefix_distance, qgrams, words
from tessera.functions.vectors import cosine
from tessera.operators import fuzzy, similarity, sparql
from tessera.plans import api


# The names, facts and expected values below are fixed values that any implementation must give.


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sparql_parse():
    text = "SELECT ?x ?y WHERE { ?x pred_1 some_obj . ?y pred_2 ?z } "
    q = sparql.parse(text)
    assert q == sparql.Query(("?x", "?y"), (("?x", "pred_1", "some_obj"), ("?y", "pred_2", "?z")))
    assert sparql.parse(text + "ORDER BY DESC(?x) LIMIT 25").order_by == ("?x", False)
    assert sparql.parse(text + "ORDER BY ASC(?Z)".replace("Z", "z") + " LIMIT 25").limit == 25
    assert sparql.parse("PREFIX a: <http://b.c/>\nSELECT ?x WHERE {\n?x a:p v1.2 .\n}").triples == (("?x", "a:p", "v1.2"),)
    for bad in ("SELECT ?q WHERE { ?x a b }", "ASK { ?x a b }", "SELECT ?x WHERE { ?x a }", "SELECT DISTINCT ?x WHERE { ?x a b }"):
        with pytest.raises(ValueError):
            sparql.parse(bad)


def test_sparql_rows(spark):
    t = spark.createDataFrame([("a", "job", "pol"), ("b", "job", "pol"), ("a", "wife", "b"), ("a", "born", "X"), ("b", "born", "X"), ("c", "likes", "c"), ("c", "likes", "o'x")], "subject string, predicate string, object string")
    text = "SELECT ?x ?y WHERE { ?x job pol . ?y job pol . ?x wife ?y . ?x born ?p . ?y born ?p }"
    assert [tuple(r) for r in sparql.run(t, text).collect()] == [("a", "b")]
    assert [tuple(r) for r in sparql.run(t, "SELECT ?x WHERE { ?x likes ?x }").collect()] == [("c",)]
    assert sparql.run(t, "SELECT ?x ?y WHERE { ?x job pol . ?y likes ?z }").count() == 4
    assert [r[0] for r in sparql.run(t, "SELECT ?x WHERE { ?x job pol } ORDER BY DESC(?x) LIMIT 1").collect()] == ["b"]
    t.createOrReplaceTempView("triples")
    for q in (text, "SELECT ?x WHERE { ?x likes o'x }", "SELECT ?x WHERE { ?x likes ?x }"):
        assert sorted(map(tuple, spark.sql(sparql.to_sql(sparql.parse(q))).collect())) == sorted(map(tuple, sparql.run(t, q).collect()))


def test_qgrams_and_normalize(spark):
    assert one(spark, qgrams(F.lit("freiburg")))[0] == ["$$f", "$fr", "fre", "rei", "eib", "ibu", "bur", "urg"]
    assert one(spark, qgrams(F.lit("f")), qgrams(F.lit(""))) == (["$$f"], [])
    assert one(spark, *(normalize(F.lit(s)) for s in ("freiburg", "Frei, burG !?!", "Frei14burg"))) == ("freiburg", "freiburg", "frei14burg")
    assert one(spark, words(F.lit("This   is a sentence.")))[0] == ["This", "is", "a", "sentence"]


def reference_distance(x, y, delta):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        new = [i + 1]
        for j, b in enumerate(y):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(delta + 1, *row) if row else 0


@pytest.mark.parametrize("x,y,d,want", [("frei", "frei", 0, 0), ("frei", "freiburg", 0, 0), ("frei", "breifurg", 4, 1), ("fr", "tifurg", 2, 2), ("freiburg", "stuttgart", 2, 3), ("", "freiburg", 10, 0), ("", "", 10, 0), ("mür", "murx", 1, 1)])
def test_prefix_distance(spark, x, y, d, want):
    assert one(spark, prefix_distance(F.lit(x), F.lit(y), d))[0] == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=6), st.text("abc", max_size=8), st.integers(0, 4)), min_size=1, max_size=20))
def test_prefix_distance_property(spark, cases):
    df = spark.createDataFrame(cases, "x string, y string, d int")
    for r in df.select("x", "y", "d", prefix_distance(F.col("x"), F.col("y"), F.col("d")).alias("p")).collect():
        assert r["p"] == reference_distance(r["x"], r["y"], r["d"])


@pytest.fixture(scope="module")
def index(spark):
    e = spark.createDataFrame([(1, "frei", 3, ["fre", "fri"], ["first"]), (2, "brei", 2, ["bre", "bri"], ["second"])], "ent_id long, name string, score long, synonyms array<string>, info array<string>")
    n = fuzzy.names_of(e)
    return api.Index(e, n, fuzzy.qgram_postings(n))


def test_find_matches(spark, index):
    got = lambda p, d: [(r["ent_id"], r["ped"]) for r in fuzzy.find_matches(index.postings, index.names, index.entities, p, d).collect()]
    assert (got("frei", 0), got("frei", 1), got("freib", 1)) == ([(1, 0)], [(1, 0), (2, 1)], [(1, 1)])
    stats = lambda p, d: tuple(fuzzy.match_stats(index.postings, index.names, p, d).first())[2]
    assert (stats("frei", 0), stats("frei", 1), stats("freib", 1)) == (1, 2, 1)
    with pytest.raises(ValueError):
        got("fr", 1)
    assert [tuple(r)[1:] for r in fuzzy.infos(index.entities, index.names, 2).collect()] == [("brei", "brei", 2, ["second"])]
    assert fuzzy.infos(index.entities, index.names, 3).count() == 0


def test_synonyms(index):
    n = fuzzy.names_of(index.entities, synonyms=True)
    assert [(r["syn_id"], r["ent_id"], r["name"]) for r in n.orderBy("syn_id").collect()] == [(1, 1, "frei"), (2, 1, "fre"), (3, 1, "fri"), (4, 2, "brei"), (5, 2, "bre"), (6, 2, "bri")]
    found = fuzzy.find_matches(fuzzy.qgram_postings(n), n, index.entities, "frib", 1).collect()
    assert [(r["ent_id"], r["syn_id"], r["ped"]) for r in found] == [(1, 3, 1)]


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [-2.0, 1.5])], "token string, vec array<float>")
    d = spark.createDataFrame([(0, "a a a b"), (1, "b b"), (2, "a b"), (3, "")], "doc_id long, text string")
    e = similarity.embed_documents(d, v, 2)
    got = {r[0]: r[1] for r in e.collect()}
    assert got == {0: [1.0, 3.0], 1: [-4.0, 3.0], 2: [-1.0, 2.0], 3: [0.0, 0.0]}
    near = lambda q, k: [(r[0], round(r[1], 3)) for r in similarity.top_k(e, q, k).collect()]
    assert near(got[0], 2) == [(0, 1.0), (2, 0.707)] and near([-2.0, 1.5], 2) == [(1, 1.0), (2, 0.894)] and near(got[0], 0) == []
    want = {(7, 0, 1), (7, 2, 2)}
    queries = spark.createDataFrame([(7, got[0])], "query_id long, qvec array<double>")
    assert {(r["query_id"], r["id"], r["rank"]) for r in similarity.top_k_of_each(e, queries, 2).collect()} == want


@pytest.mark.parametrize("v,want", [([10.0, 0.0], 1), ([0.0, 0.1], 0), ([8.0, 8.0], 0.707), ([-4.5, 0.0], -1), ([0.0, 0.0], 0)])
def test_cosine(spark, v, want):
    q = F.array(F.lit(4.0), F.lit(0.0))
    assert round(one(spark, cosine(q, F.array(*map(F.lit, v))))[0], 3) == want


def test_api(spark, index):
    status, body = api.respond(index, "GET", "/api/search?q=Frei")
    assert status == 200 and json.loads(body)["total"] == 2 and json.loads(body)["results"][0]["name"] == "frei"
    assert api.respond(index, "POST", "/api/search?q=a")[0] == 405 and api.respond(index, "GET", "/../x")[0] == 403
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "ent_id long, vec array<double>")
    assert [r[0] for r in api.similar_documents(index, vectors, "frei", 1).collect()] == [1, 2]


def test_relations(spark):
    facts = [("m", "P1", "o1"), ("m", "P1", "o2"), ("m", "P2", "o1"), ("P1", "label", "cast"), ("P2", "label", "by"), ("P1", "count", "9"), ("P2", "count", "10"), ("o1", "label", "Ann"), ("o2", "label", "Bob")]
    t = spark.createDataFrame(facts, "subject string, predicate string, object string")
    assert [tuple(r) for r in sparql.relations(t, "m").collect()] == [("by", "Ann"), ("cast", "Ann, Bob")]
