"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from a bounded sample of labelled texts. A text, lower-cased
and reduced to its letters, is compressed whole with each dictionary, in blocks; the least cost names the language. The cost
is the size in bytes less a share of one byte: sizes are whole bytes, and languages whose dictionaries hold more of the
text's words get more of the byte that rounding hides. A text is rejected when the runner-up costs less than MARGIN more, and
by nothing else. Equal costs go to the first language by name.

`und`: texts that are null or have no letter, and all texts if no labelled text exists; their score is 0 and they are
rejected. Languages are whatever non-null labels occur; where they are many, each gets a smaller sample and dictionary.
Very long texts are judged whole. Extra columns stay, except those with an output's name; repeated rows get equal results,
and empty tables pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from .common import map_columns

#: The sample that a language's dictionary is made from: texts, characters of each (a run that begins anywhere in it) and
#: bytes of all; and the bytes of all dictionaries together, which shrinks these with more than 200 languages.
SAMPLE_TEXTS, SAMPLE_TEXT_CHARS, DICTIONARY_BYTES, ALL_BYTES = 192, 4_000, 64_000, 12_800_000
BLOCK_CHARS = 4_096
#: Matches of 4 bytes are worth finding in short texts.
ZSTD = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 4, "min_match": 4, "target_length": 32}
#: Runner-up's excess in parts of the least cost below which a text is rejected.
MARGIN = 0.002
#: Scores are 1 - exp(-excess / SCALE).
SCALE = 0.02



def letters_of(text: str) -> str:
    """The text's letters, runs of anything else being one space. Numerals such as fractions are no letters."""
    return _not_letters().sub(" ", text).strip().lower()


@cache
def _not_letters():
    import regex

    return regex.compile(r"\P{L}+")


def fit(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, from the SAMPLE_TEXTS allowed rows of each whose ids hash lowest.

    Row ids are picked by a map-side aggregate without texts; only the picked rows' texts are then fetched.
    """
    rows = docs.where(allowed).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null and id is not null")
    n_langs = rows.select("lang").distinct().count()
    if not n_langs:
        return {}
    part = min(1.0, ALL_BYTES / (n_langs * DICTIONARY_BYTES))
    n_texts, n_bytes = max(1, int(SAMPLE_TEXTS * part)), max(8, int(DICTIONARY_BYTES * part))
    mix = F.xxhash64(F.col("id"))
    picked = rows.groupBy("lang", F.pmod(mix, F.lit(n_texts)).alias("slot")).agg(F.min_by("id", F.xxhash64(mix)).alias("id")).select("id", F.col("lang").alias("of")).distinct()
    text = F.col(f"`{text_col}`")
    begin = 1 + F.pmod(F.xxhash64(text), F.greatest(F.length(text) - SAMPLE_TEXT_CHARS, F.lit(0)) + 1)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.substring(text, begin.cast("int"), F.lit(SAMPLE_TEXT_CHARS)).alias("text"))
    texts = texts.join(F.broadcast(picked), "id").where("lang = of and text is not null").groupBy("id", "lang").agg(F.min("text").alias("text"))
    by: dict[str, list[tuple]] = {}
    for r in texts.collect():
        by.setdefault(r["lang"], []).append((r["id"], letters_of(r["text"])))
    out = {}
    for lang, found in sorted(by.items()):
        data = " ".join(t for _, t in sorted(found)).encode()[-n_bytes:]
        if len(data) >= 8:
            out[lang] = data
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = sorted(dictionaries)
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False, **ZSTD)
        self.by = []
        self.words = [Counter(dictionaries[lang].decode(errors="ignore").split()) for lang in self.langs]
        self.totals = [max(1, c.total()) for c in self.words]
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        text = letters_of(text) if text else ""
        if not text or not self.langs:
            return "und", 0.0, True
        sizes = [0] * len(self.langs)
        for k in range(0, len(text), BLOCK_CHARS):
            block = text[k : k + BLOCK_CHARS].encode()
            for i, compress in enumerate(self.by):
                sizes[i] += len(compress(block))
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        least, second = sorted(sizes)[:2]
        costs: list[float] = sizes
        if second - least <= 1 + MARGIN * least:  # else no share of a byte matters
            words = text.split()
            support = [sum(c[w] for w in words) / n for c, n in zip(self.words, self.totals, strict=True)]
            total = sum(support)
            costs = [size - (own / total if total else 0) for size, own in zip(sizes, support, strict=True)]
        order = sorted(range(len(costs)), key=costs.__getitem__)
        excess = costs[order[1]] / costs[order[0]] - 1
        return self.langs[order[0]], 1 - math.exp(-excess / SCALE), excess < MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected."""
    # at most ALL_BYTES, or 8 bytes a language
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        judge = Classifier(shared.value).judge

        def run(texts: pa.Array):
            found = [judge(t) for t in texts.to_pylist()]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]

        return run

    outputs = [StructField("lang_pred", StringType(), False), StructField("score", DoubleType(), False), StructField("rejected", BooleanType(), False)]
    return map_columns(docs, [text_col], outputs, make, () if keep_text else (text_col,))
