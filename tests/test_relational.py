import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as rel
from tessera.plans import cost
from tessera.sources import readers, writers

PERSONS = "id\tname\tage\tjob_id\n0\tJohn\t29\t0\n1\tMary\t18\t2\n2\tPeter\t38\t1\n3\tJane\t\t1\n4\tMark\t38\t0\n5\tLisa\t20\t5\n"
JOBS = "id\tjob_title\n0\tmanager\n1\tsecretary\n2\tsoftware engineer\n3\tceo\n"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tsv")
    (d / "persons.tsv").write_text(PERSONS)
    (d / "jobs.tsv").write_text(JOBS)
    return readers.table_tsv(spark, str(d / "persons.tsv")), readers.table_tsv(spark, str(d / "jobs.tsv"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scan(tables):
    persons, jobs = tables
    assert writers.shape(persons) == (6, 4) and writers.shape(jobs) == (4, 2)
    assert rows(persons)[3] == ("3", "Jane", None, "1")
    assert "?" in writers.shown(persons)


def test_project(tables):
    persons, _ = tables
    assert persons.columns[1:3] == rel.project(persons, [1, 2]).columns
    assert len(rows(rel.project(persons, [2]))) == 6
    assert sorted(rows(rel.project(persons, [2], distinct=True)), key=str) == [("18",), ("20",), ("29",), ("38",), (None,)]
    with pytest.raises(ValueError):
        rel.project(persons, [])
    with pytest.raises(IndexError):
        rel.project(persons, [4])


def test_select(tables):
    persons, _ = tables
    assert len(rows(rel.select(persons, F.col("name") == "John"))) == 1
    old = F.coalesce(rel.column(persons, 2).try_cast("int"), F.lit(0)) > 30
    assert {r[1] for r in rows(rel.select(persons, old))} == {"Peter", "Mark"}
    assert {r[1] for r in rows(rel.select_rows(persons, lambda r: int(r[2] or 0) > 30))} == {"Peter", "Mark"}


@pytest.mark.parametrize("how,n", [("inner", 5), ("left_outer", 6), ("right_outer", 6)])
def test_join(tables, how, n):
    joined = rel.join(*tables, 3, 0, how)
    assert joined.columns == ["id", "name", "age", "job_id", "id", "job_title"]
    found = rows(joined)
    assert len(found) == n
    if how == "left_outer":
        assert [r for r in found if r[1] == "Lisa"][0][4:] == (None, None)
    if how == "right_outer":
        assert [r for r in found if r[5] == "ceo"][0][:4] == (None,) * 4
    with pytest.raises(ValueError):
        rel.join(*tables, 3, 0, "full")


def test_null_keys_match_nothing(spark):
    a = spark.createDataFrame([(None,), ("x",)], "k string")
    assert rows(rel.join(a, a, 0, 0)) == [("x", "x")]


def test_order_and_limit(tables):
    persons, _ = tables
    assert [r[1] for r in rows(rel.order_by(persons, 2, then=[0]))] == ["Jane", "Mary", "Lisa", "John", "Peter", "Mark"]
    assert [r[1] for r in rows(rel.order_by(persons, 2, False, then=[0]))] == ["Peter", "Mark", "John", "Lisa", "Mary", "Jane"]
    assert len(rows(rel.limit(persons, 2))) == 2
    with pytest.raises(ValueError):
        rel.limit(persons, 0)


def test_group(tables):
    persons, _ = tables
    got = {r[0]: r[1:] for r in rows(rel.group_by(persons, [2], [(1, rel.joined()), (0, rel.integer_product), (3, rel.integer_sum)]))}
    assert got == {"18": ("Mary", 1, 2), "20": ("Lisa", 5, 5), "29": ("John", 0, 0), "38": ("Mark, Peter", 8, 1), None: ("Jane", 3, 1)}
    for bad in (([2, 2], [(1, rel.joined())]), ([2], [(2, rel.joined())]), ([2], [])):
        with pytest.raises(ValueError):
            rel.group_by(persons, *bad)
    assert rows(rel.group_by(persons, [3], [(2, rel.mean(null_as_zero=True))]).where("job_id = '1'"))[0][1] == 19.0


def test_ties(spark):
    df = spark.createDataFrame([(1, 5.0, "b"), (1, 5.0, "a"), (1, 4.0, "c"), (2, 1.0, "d")], "g int, v double, s string")
    assert sorted(rows(rel.top_with_ties(df, ["g"], "v", "s"))) == [(1, 5.0, "a; b"), (2, 1.0, "d")]


def test_same_bag(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert rel.same_bag(a, a.orderBy(F.desc("x"))) and not rel.same_bag(a, a.distinct())


def test_cost():
    a, b = cost.Shape(100, 4), cost.Shape(10, 2)
    assert a.select() == cost.Shape(50, 4, 400) and a.project(1) == cost.Shape(100, 1, 100)
    assert a.join(b) == cost.Shape(10, 6, 170) and cost.ratio(a.join(b), a.project(1)) == 1.7


def test_movie_queries(spark):
    movies = spark.createDataFrame([(0, "Fargo", 1996, 8.1), (1, "Kramer vs Kramer", 1979, 7.8), (3, "Titanic", 1997, 7.9)], "id int, title string, release_year int, imdb_score double")
    persons = spark.createDataFrame([(0, "Joel Coen"), (1, "Ethan Coen"), (2, "Someone")], "id int, name string")
    roles = spark.createDataFrame([(0, 0, 0, "director"), (1, 0, 1, "director"), (2, 0, 2, "actor")], "id int, movie_id int, person_id int, role string")
    q = "SELECT p.name FROM movies m, persons p, roles r WHERE m.id = r.movie_id AND p.id = r.person_id AND m.title = 'Fargo' AND r.role = 'director'"
    assert {r[0] for r in rows(readers.run_sql(spark, q, movies=movies, persons=persons, roles=roles))} == {"Joel Coen", "Ethan Coen"}
    assert rows(readers.run_sql(spark, "SELECT release_year, imdb_score FROM movies WHERE title = 'Titanic'", movies=movies)) == [(1997, 7.9)]
    assert rel.cross(movies, persons).count() == 9


def test_sources(spark, tmp_path):
    (tmp_path / "docs.tsv").write_text('A "b\tx y\t3\t1.5\t2\nC\td\t1\t2\t0\n')
    docs = rows(readers.documents_tsv(spark, str(tmp_path / "docs.tsv")))
    assert docs == [(1, 'A "b', "x y", 3, 1.5, 2), (2, "C", "d", 1, 2.0, 0)]
    (tmp_path / "ent.tsv").write_text("name\tscore\tsynonyms\tinfo\nfrei\t3\tfre;;fri\tone\ttwo\nbrei\t2\t\n")
    ents = rows(readers.entities_tsv(spark, str(tmp_path / "ent.tsv")))
    assert ents == [(1, "frei", 3, ["fre", "fri"], ["one", "two"]), (2, "brei", 2, [], [])]
    (tmp_path / "q.tsv").write_text("animated film\t1 3 4\nshort film\t3 4\n")
    queries, qrels = readers.qrels_tsv(spark, str(tmp_path / "q.tsv"))
    assert rows(queries) == [(1, "animated film"), (2, "short film")] and sorted(rows(qrels)) == [(1, 1), (1, 3), (1, 4), (2, 3), (2, 4)]
    (tmp_path / "t.tsv").write_text("a\tp\tb\n")
    assert readers.triples_tsv(spark, str(tmp_path / "t.tsv"), str(tmp_path / "t.tsv")).count() == 2
    frame = spark.createDataFrame([("b", 1), ("a", 2)], "term string, doc_id long")
    writers.write_index(frame, str(tmp_path / "ix"))
    assert rel.same_bag(frame, readers.read_index(spark, str(tmp_path / "ix")))
    writers.append_report(frame, str(tmp_path / "rep"))
    writers.append_report(frame, str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "rep")).count() == 4
