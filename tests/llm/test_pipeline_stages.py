"""Every stage of the pipeline over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(C.COLUMNS)
    long = " ".join(r["text"] for r in docs.where("text is not null and lang = 'en'").collect()) * 3
    assert len(long) > 300_000
    some = docs.where("doc_id < 20").first()
    extra = [(9001, long, "en", None, None), (9002, long + " more", None, "x", 1), (9003, None, None, None, None), (9004, "", "en", "x", 0), (9005, " \n ", "en", "x", 3), (9006, "½ 12", "en", "x", 4), (None, some["text"], "en", "x", 1), (None, some["text"], "en", "x", 1), (None, None, None, None, None), (9007, some["text"], "en", "x", 1), (9007, some["text"], "en", "x", 1)]
    every = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars int").select(*(F.col(c).cast(docs.schema[c].dataType) for c in C.COLUMNS)))
    clashing = {"score": "double", "lang_pred": "string", "rejected": "boolean", "predicted": "int", "v": "string", "prints": "int", "bits": "int", "size": "int", "prefix": "string", "class_id": "int", "root": "int", "n_hit": "int", "spans": "int", "__key": "int", "ids": "string", "digest": "string", "decoded": "int", "exact": "int", "n_tokens": "int"}
    path = "/tmp/checkpoints/tessera-tests/odd.parquet"
    every.select("*", *(F.lit(None).cast(t).alias(c) for c, t in clashing.items())).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("name", "stage"), C.STAGES)
def test_odd_rows(spark, odd, name, stage):
    found = stage(spark, odd, SF)
    assert found.columns == (["doc_id", "n_tokens", "ids", "exact"] if name == "bpe" else C.COLUMNS)
    rows = found.collect()
    ids = [r["doc_id"] for r in rows]
    n = odd.count()
    if name == "language":
        assert not set(ids) & {9003, 9004, 9005, 9006} and {9001, 9002, 9007} <= set(ids) and ids.count(9007) == 2 and ids.count(None) == 2 and len(rows) > 0.9 * n - 5
    elif name == "toxicity":
        assert {9003, 9004, 9005, 9006} <= set(ids) and ids.count(9007) in (0, 2) and len(rows) > 0.7 * n
    elif name == "near_duplicates":
        texts = [" ".join((r["text"] or "").lower().split()) for r in rows if r["doc_id"] is not None]
        assert 9001 in ids and 9002 not in ids and 9007 not in ids and ids.count(None) == 2  # one row of each text without an id
        assert len(set(texts)) == len(texts)
    elif name == "decontamination":
        assert {9003, 9004, 9005, 9006} <= set(ids) and len(rows) > 0.7 * n
    else:
        assert len(rows) == n and all(r["exact"] for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (9003, 9004)} == {0}


@pytest.mark.parametrize(("name", "stage"), C.STAGES)
def test_empty_tables(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).collect() == []
