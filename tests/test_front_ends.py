"""Command lines, shared folders, statistics, opaque aggregates, and ranks counted in blocks."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev, fuzzy, inverted as inv, relational as rel, similarity
from tessera.plans import api, cli
from tessera.sources import readers, scratch, writers


def said(spark, words, lines=()):
    out = []
    cli.main(words, spark, lines, out.append)
    return out


def test_search_line(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("Movie\tAnimated movie.\nMovie\tNon-animated film.\nMovie\tShort animation.\nMovie\tShort animated short film.\n")
    out = said(spark, ["search", str(tmp_path / "d.tsv"), "-k", "1"], ["short film\n", "absent\n", "\n", "film\n"])
    mark = lambda w: f"\033[1;31m{w}\033[0m"
    assert out == [f"Movie\n{mark('Short')} animated {mark('short')} {mark('film')}.\n", "3 documents", "0 documents"]


def test_sparql_line(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tjob\tpol\nb\tjob\tpol\n")
    (tmp_path / "good.rq").write_text("PREFIX x: <y>\nSELECT ?x WHERE {\n?x job pol\n} ORDER BY ASC(?x)")
    (tmp_path / "bad.rq").write_text("SELECT ?y WHERE { ?x job pol }")
    out = said(spark, ["sparql", str(tmp_path / "t.tsv"), str(tmp_path / "good.rq")])
    assert out[0].split("\n") == ["| x |", "|---|", "| a |", "| b |"] and out[1].startswith("2 rows in ")
    assert said(spark, ["sparql", str(tmp_path / "t.tsv"), str(tmp_path / "bad.rq")]) == ["invalid query: unknown variable ?y"]


def test_fuzzy_line(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("name\tscore\tsynonyms\tinfo\nfrei\t3\tfre;fri\tone\ttwo\nbrei\t2\t\tthree\n")
    out = said(spark, ["fuzzy", str(tmp_path / "e.tsv"), "--synonyms"], ["Frei!", "?"])
    assert out[:2] == ["frei (distance 0, score 3): one, two", "brei (distance 1, score 2): three"]
    assert out[2].startswith("4 lists, ") and ", 4 matches, " in out[2] and out[3] == "no letters to search for"


class Session:
    """What shared_dir asks of a session."""

    def __init__(self, master, named=None):
        self.conf, self.sparkContext, self.master, self.named = self, self, master, named

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_shared_folder():
    assert scratch.shared_dir(Session("local[4]")) == scratch.shared_dir(Session("local")) == scratch.LOCAL_SHARED_DIR
    assert scratch.shared_dir(Session("local[4]", "file:///a")) == scratch.shared_dir(Session("spark://host:7077", "file:///a")) == "file:///a"
    for master in ("spark://host:7077", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(ValueError):
            scratch.shared_dir(Session(master))
    assert scratch.fresh_path(Session("local"), "x") != scratch.fresh_path(Session("local"), "x")


def test_line_numbers_of_many_partitions(spark):
    lines = spark.createDataFrame([(f"line {i}",) for i in range(1, 101)], "value string").repartitionByRange(9, F.expr("cast(substring(value, 6) as int)")).sortWithinPartitions(F.expr("cast(substring(value, 6) as int)"))
    numbered = readers._line_numbers(lines.coalesce(3)).collect()
    assert sorted(r["line"] for r in numbered) == list(range(1, 101))
    assert readers._line_numbers(lines.limit(0)).collect() == []


def test_statistics(spark):
    df = spark.createDataFrame([(1, "b"), (1, None), (3, "a")], "n int, s string")
    assert {tuple(r) for r in writers.statistics(df).collect()} == {("n", 3, 0, 2, "1", "3"), ("s", 3, 1, 2, "a", "b")}


def test_opaque_aggregate_and_single_label(spark):
    df = spark.createDataFrame([("x", 1, "b"), ("x", 5, "d"), ("x", 5, "c"), ("y", None, "e")], "g string, v int, s string")
    got = rel.group_by(df, [0], [(1, rel.opaque(lambda v: int(v.fillna(0).max() * 2), "long"))])
    assert {tuple(r) for r in got.collect()} == {("x", 10), ("y", 0)}
    assert {tuple(r) for r in rel.top_with_one(df, ["g"], "v", "s").collect()} == {("x", 5, "c"), ("y", None, None)}


@pytest.mark.parametrize("limit", [10_000, 0])
def test_ranks_in_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(ev, "BROADCAST_QUERIES", limit)
    monkeypatch.setattr(ev, "RANK_BLOCK", 7)
    monkeypatch.setattr(ev, "SCORE_BLOCKS", 5)
    rows = [(q, d, float((d * 7919 + q) % 13)) for q in (1, 2, 3) for d in range(40 * q)]
    scored = spark.createDataFrame(rows, "query_id long, doc_id long, score double")
    want = {(q, d): i for k in (1, 2, 3) for i, (q, d, _) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])), 1)}
    ranked = ev.with_ranks(scored)
    assert {(r["query_id"], r["doc_id"]): r["rank"] for r in ranked.collect()} == want
    relevant = [(q, d) for q, d in want if d % 3 == 0]
    got = ev.per_query(spark.createDataFrame([(q,) for q in (1, 2, 3, 4)], "query_id long"), ranked, spark.createDataFrame(relevant, "query_id long, doc_id long"), 3)
    for r in got.collect():
        own = sorted(want[x] for x in relevant if x[0] == r["query_id"])
        assert r["ap"] == pytest.approx(sum((i + 1) / at for i, at in enumerate(own)) / len(own) if own else 0.0)
        assert r["p_at_k"] == pytest.approx(sum(at <= 3 for at in own) / 3) and r["p_at_r"] == pytest.approx(sum(at <= len(own) for at in own) / len(own) if own else 0.0)


def test_beyond_what_is_broadcast(spark, monkeypatch):
    """The joins give the same rows where a side is too large to be broadcast."""
    v = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [-2.0, 1.5])], "token string, vec array<float>")
    d = spark.createDataFrame([(0, "a a a b"), (1, "b b"), (3, "")], "doc_id long, text string")
    p = spark.createDataFrame([("foo", 1, 0.5), ("foo", 3, 0.25), ("bar", 1, 0.5)], "term string, doc_id long, score double")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, qvec array<double>")
    runs = []
    for limit in (10_000, 0):
        monkeypatch.setattr(similarity, "BROADCAST_TOKENS", limit)
        monkeypatch.setattr(similarity, "BROADCAST_QUERIES", limit)
        monkeypatch.setattr(inv, "BROADCAST_TERMS", limit)
        monkeypatch.setattr(readers, "BROADCAST_PARTS", limit)
        e = similarity.embed_documents(d, v, 2)
        made = [e, inv.ranked(p, inv.query_terms(spark, {1: "foo bar", 2: "bar bar"})), similarity.top_k_of_each(e, q, 2), readers._line_numbers(d.select(F.col("text").alias("value")))]
        runs.append([sorted(map(str, x.collect())) for x in made])
    assert runs[0] == runs[1]


def test_boolean_search_and_escapes(spark):
    d = spark.createDataFrame([(1, "A movie movie."), (2, "A film."), (3, None)], "doc_id long, text string")
    hits = lambda *w: [r[0] for r in inv.boolean_search(d, F.col("text"), list(w)).collect()]
    assert (hits("a"), hits("a", "movie"), hits(), hits("none")) == ([1, 2], [1], [], [])
    df = spark.createDataFrame([("a.b axb a.b",)], "s string")
    assert df.select(inv.highlight(F.col("s"), ["a.b"], "<", ">")).first()[0] == "<a.b> axb <a.b>"
    postings = inv.bm25_postings(d, F.col("text"))
    assert [(r["doc_id"], r["total"]) for r in inv.search_with_total(postings, "film movie", 1).collect()][0][1] == 2
    assert inv.bm25_postings(d.limit(0), F.col("text")).collect() == []


def test_forbidden_paths(spark):
    e = spark.createDataFrame([(1, "frei", 3, ["fre"], ["first"])], "ent_id long, name string, score long, synonyms array<string>, info array<string>")
    n = fuzzy.names_of(e)
    index = api.Index(e, n, fuzzy.qgram_postings(n))
    assert [api.respond(index, "GET", t)[0] for t in ("/a/../../b", "/%2e%2e/b", "/a..b")] == [403, 403, 404]
    assert json.loads(api.respond(index, "GET", "/api/search?q=")[1]) == {"error": "not found"}
