import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev, inverted as inv

# Documents and the scores that any implementation must give for them.
DOCS = [(1, "Movie", "Animated movie."), (2, "Movie", "Non-animated film."), (3, "Movie", "Short animation."), (4, "Movie", "Short animated short film.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, description string")


TEXT = lambda: inv.doc_text("title", "description")


def lists(df):
    out = {}
    for r in df.orderBy("term", "doc_id").collect():
        out.setdefault(r["term"], []).append((r["doc_id"], round(r["score"], 3)))
    return out


def test_boolean(spark):
    d = spark.createDataFrame([(1, "Doc 1", "A movie movie."), (2, "Doc 2", "A film."), (3, "Doc 3", "Movie.")], "doc_id long, title string, description string")
    p = inv.boolean_postings(d, TEXT())
    got = {}
    for r in p.orderBy("term", "doc_id").collect():
        got.setdefault(r[0], []).append(r[1])
    assert got == {"a": [1, 2], "doc": [1, 2, 3], "film": [2], "movie": [1, 3]}
    hits = lambda *w: [r[0] for r in inv.boolean_and(p, list(w)).orderBy("doc_id").collect()]
    assert (hits(), hits("doc"), hits("doc", "movie"), hits("doc", "movie", "comedy")) == ([], [1, 2, 3], [1, 3], [])


@pytest.mark.parametrize(
    "b,k,want",
    [
        (0.75, 1.75, {"animated": [(1, 0.459), (2, 0.402), (4, 0.358)], "animation": [(3, 2.211)], "film": [(2, 0.969), (4, 0.863)], "movie": [(i, 0.0) for i in range(1, 5)], "non": [(2, 1.938)], "short": [(3, 1.106), (4, 1.313)]}),
        (0.0, math.inf, {"animated": [(1, 0.415), (2, 0.415), (4, 0.415)], "animation": [(3, 2.0)], "film": [(2, 1.0), (4, 1.0)], "movie": [(i, 0.0) for i in range(1, 5)], "non": [(2, 2.0)], "short": [(3, 1.0), (4, 2.0)]}),
        (0.0, 0.0, {"animated": [(1, 0.415), (2, 0.415), (4, 0.415)], "animation": [(3, 2.0)], "film": [(2, 1.0), (4, 1.0)], "movie": [(i, 0.0) for i in range(1, 5)], "non": [(2, 2.0)], "short": [(3, 1.0), (4, 1.0)]}),
    ],
)
def test_bm25(docs, b, k, want):
    assert lists(inv.bm25_postings(docs, TEXT(), b=b, k=k)) == want
    some = lists(inv.bm25_postings(docs, TEXT(), b=b, k=k, terms=["short", "film", "absent"]))
    assert some == {w: want[w] for w in ("short", "film")}


def test_scored_lists(spark):
    p = spark.createDataFrame([("foo", 1, 0.2), ("foo", 3, 0.6), ("bar", 1, 0.4), ("bar", 2, 0.7), ("bar", 3, 0.5), ("baz", 2, 0.1)], "term string, doc_id long, score double")
    got = lambda q: [(r[0], round(r[1], 6)) for r in inv.search(p, q).collect()]
    assert got("foo bar") == [(3, 1.1), (2, 0.7), (1, 0.6)]
    assert got("bar") == [(2, 0.7), (3, 0.5), (1, 0.4)]
    assert got("barb") == [] and got("") == []
    assert got("foo bar baz") == [(3, 1.1), (2, 0.8), (1, 0.6)]
    p = spark.createDataFrame([("foo", 1, 0.2), ("foo", 3, 0.6), ("bar", 2, 0.4), ("bar", 3, 0.1), ("bar", 4, 0.8)], "term string, doc_id long, score double")
    got = [(r[0], round(r[1], 6)) for r in inv.search(p, "foo bar foo bar").collect()]
    assert got == [(4, 1.6), (3, 1.4), (2, 0.8), (1, 0.4)]


def test_matrix_search_equals_search(docs):
    p = inv.bm25_postings(docs, TEXT())
    assert [r[0] for r in inv.matrix_search(p, docs, "short film").collect()] == [4, 3, 2, 1]
    found = {r[0]: r[1] for r in inv.search(p, "short film").collect()}
    for r in inv.matrix_search(p, docs, "short film").collect():
        assert r[1] == pytest.approx(found.get(r[0], 0.0))


def test_set_operations(spark):
    a = spark.createDataFrame([(1, 2.1), (5, 3.2)], "doc_id long, score double")
    b = spark.createDataFrame([(1, 1.7), (2, 1.3), (6, 3.3)], "doc_id long, score double")
    assert sorted((r[0], round(r[1], 3)) for r in inv.union_scored(a, b).collect()) == [(1, 3.8), (2, 1.3), (5, 3.2), (6, 3.3)]
    assert sorted((r[0], r[1]) for r in inv.union_scored(a, b.limit(0)).collect()) == [(1, 2.1), (5, 3.2)]
    assert [r[0] for r in inv.intersect(a, b).collect()] == [1]


def test_highlight(spark):
    df = spark.createDataFrame([("The movie theatre, THE end",)], "s string")
    assert df.select(inv.highlight(F.col("s"), ["the", "end"], "<", ">")).first()[0] == "<The> movie theatre, <THE> <end>"


def test_evaluate(spark, docs):
    queries = {1: "animated film", 2: "short film"}
    scored = inv.ranked(inv.bm25_postings(docs, TEXT()), inv.query_terms(spark, queries))
    qrels = spark.createDataFrame([(1, 1), (1, 3), (1, 4), (2, 3), (2, 4)], "query_id long, doc_id long")
    numbers = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert tuple(ev.means(ev.per_query(numbers, ev.with_ranks(scored), qrels)).first()) == (0.667, 0.833, 0.694)


@pytest.mark.parametrize("results,relevant,k,p,ap", [([5, 3, 6, 1, 2], [1, 2, 5, 6, 7, 8], 4, 0.75, None), ([5, 3, 6, 1, 2], [1, 2, 5, 6, 7, 8], 8, 0.5, None), ([], [1, 2], 5, 0.0, 0.0), ([3, 4], [3, 4], 2, 1.0, 1.0), ([7, 17, 9, 42, 5], [5, 7, 12, 42], 3, None, 0.525), ([1, 3], [5, 7, 12, 42], 3, 0.0, 0.0), ([5, 7], [5, 7, 12, 42], 2, 1.0, 0.5), ([5], [], 1, 0.0, 0.0)])
def test_measures(spark, results, relevant, k, p, ap):
    r = spark.createDataFrame([(1, i + 1, d) for i, d in enumerate(results)], "query_id long, rank int, doc_id long")
    q = spark.createDataFrame([(1, d) for d in relevant], "query_id long, doc_id long")
    got = ev.per_query(spark.createDataFrame([(1,)], "query_id long"), r, q, k).first()
    assert p is None or got["p_at_k"] == pytest.approx(p)
    assert ap is None or got["ap"] == pytest.approx(ap)


def test_no_queries(spark):
    empty = spark.createDataFrame([], "query_id long, p_at_k double, p_at_r double, ap double")
    assert tuple(ev.means(empty).first()) == (0.0, 0.0, 0.0)
