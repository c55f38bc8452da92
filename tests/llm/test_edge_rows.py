"""Every operator over nulls, empty and long texts, repeated rows, empty tables, and columns with clashing names."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, decontaminate, html_text, huffman, language, licenses, media, queries, simhash, toxicity, url_filters
from tessera.llm.common import inline_table

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
NET = toxicity.train(["ta re no mi"] * 6 + ["ta grumpf no"] * 6, [0] * 6 + [1] * 6)
DICTIONARIES = {"en": b"the and of it is that with " * 9, "de": b"der die und das ist mit von " * 9}
CLASHING = "score double, ids string, word string, fingerprint int, spans string, n_hit string, host int, rule int, n_chars int, media int, matches string, v int, key int, predicted string, decoded int, n_bytes string, __key int"


def rules(spark):
    return inline_table(spark, queries.RULES, "host string, path string, verdict string")


OPERATORS = {
    "simhash": lambda s, d: simhash.classes(d),
    "toxicity": lambda s, d: toxicity.predict(d, NET),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "the end of it")], "item_id long, text string")),
    "bpe": lambda s, d: bpe.decode(bpe.encode(d, RANKS, P.PATTERN), RANKS),
    "html": lambda s, d: html_text.extract_text(d.withColumnRenamed("text", "html").withColumn("url", F.col("html"))),
    "huffman": lambda s, d: huffman.read(s, huffman.write(d, P.path("byte_bpe_50k.json"), 0, 50_257)),
    "urls": lambda s, d: url_filters.classify(d, rules(s), "text"),
    "media": lambda s, d: media.features(media.encode(d, "text")),
    "language": lambda s, d: language.predict(d, DICTIONARIES),
    "licenses": lambda s, d: licenses.scan(d),
}


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "the end of it"), (1, "the end of it"), (2, None), (3, ""), (None, "the end of it"), (None, None), (4, "ta http://x.com/ <p> " * 20_000), (5, "   \n"), (6, "é" * 10)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    return rows.select("*", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in CLASHING.split(", ")))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, odd, name):
    found = OPERATORS[name](spark, odd)
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    assert len(found.collect()) == odd.count()


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](spark, odd.limit(0)).collect() == []


def test_equal_rows_get_equal_results(spark, odd):
    for name in ("simhash", "toxicity", "decontaminate", "language", "licenses"):
        rows = [r.asDict() for r in OPERATORS[name](spark, odd).where("doc_id = 1").collect()]
        assert len(rows) == 2 and rows[0] == rows[1]


def test_fit_without_labels(spark, odd):
    docs = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert language.fit(docs, F.lit(True)) == {}
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.predict(docs, toxicity.fit(docs, empty, F.lit(True))).collect()} == {0}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "decontamination", "bpe"]
    rows = corpus_pipeline.run(spark, sf)
    kept = {r["doc_id"]: r for r in rows.collect()}
    assert len(kept) == rows.count() > 0.7 * docs.count() and all(r["exact"] for r in kept.values())
    # each decision took effect
    copies = docs.groupBy("text").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).where("size(ids) > 1").collect()
    assert copies and all(len(kept.keys() & set(r["ids"])) <= 1 for r in copies)
    dirty = {r[0] for r in decontaminate.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").select("doc_id").collect()}
    assert dirty and not dirty & kept.keys()
