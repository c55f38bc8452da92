"""A corpus pipeline: language, toxicity, near duplicates, benchmark contamination, then token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents, and no others that docs may have. Texts of any length are read whole.

Null, empty and letterless texts are rejected by the first stage. Null ids are kept where their texts are; in the third
stage one row of each distinct text among them stays, and of repeated rows one. Ties there go to the smallest id. Repeated
rows reach the later stages only if their ids differ, and each gets its own result. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, decontaminate, language, near_copies, toxicity
from tessera.llm.common import held_out, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter or fit two languages equally well."""
    judged = language.predict(docs, language.fit(docs, ~held_out(F.col("doc_id"), 5, 0)))
    return judged.where("not rejected").select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that score at least toxicity.THRESHOLD."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    return toxicity.predict(docs, net).where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_copies.one_of_each(docs).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts of which a twentieth or more are words of benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(COLUMNS)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): the ids, and whether decoding them gives the text's bytes again."""
    path = public_tokenizers.path(RANKS)
    named = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    back = bpe.decode(bpe.encode(named, path, public_tokenizers.PATTERN, keep_text=False), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("exact"))


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_ids),
]

#: SQL has neither the compressors nor the network nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
