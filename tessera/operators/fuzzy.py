"""Fuzzy prefix search: q-gram candidates, then prefix edit distance.

names(syn_id, ent_id, name, norm_name): one row for each name of an entity; qgram_postings(qgram, syn_id, freq).
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tokens import normalize, prefix_distance, qgrams

#: Characters of names, as many q-grams, that a task of qgram_postings counts, about.
CHARS_A_TASK = 500_000


def normalized(query: str) -> str:
    return re.sub(r"\W+", "", query).lower()


def delta_for(prefix: str, q: int = 3) -> int:
    """The largest distance that leaves at least one q-gram in common."""
    return len(prefix) // (q + 1)


def qgrams_of(word: str, q: int = 3) -> list[str]:
    padded = "$" * (q - 1) + word
    return [padded[i : i + q] for i in range(len(word))]


def names_of(entities: DataFrame, synonyms: bool = False) -> DataFrame:
    """(syn_id, ent_id, name, norm_name). With synonyms each entity's name and then its synonyms, numbered in that order by (entity, place)."""
    if not synonyms:
        return entities.select(F.col("ent_id").alias("syn_id"), "ent_id", "name", normalize(F.col("name")).alias("norm_name"))
    every = entities.select("ent_id", F.posexplode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("place", "name"))
    # the running count of names of earlier entities, without bringing all to one task
    sizes = entities.select("ent_id", (1 + F.size(F.coalesce("synonyms", F.array().cast("array<string>")))).alias("n"))
    starts = _running(sizes)
    return every.join(starts, "ent_id").select((F.col("start") + F.col("place") + 1).alias("syn_id"), "ent_id", "name", normalize(F.col("name")).alias("norm_name"))


def _running(sizes: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(ent_id, start): the sum of n over smaller ids, by blocks of ids; the driver orders one number for each block."""
    blocked = sizes.withColumn("block", F.floor(F.col("ent_id") / block))
    totals = blocked.groupBy("block").agg(F.sum("n").alias("n"))
    before = totals.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("block").orderBy("ent_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "block").select("ent_id", (F.col("base") + F.col("inner")).alias("start"))


def qgram_postings(names: DataFrame, q: int = 3) -> DataFrame:
    """(qgram, syn_id, freq). The names are dealt out by syn_id, in parts by their characters, and their q-grams counted there:
    by bytes a task would get so many names that their q-grams outgrow it."""
    chars = names.agg(F.sum(F.length("norm_name"))).first()[0] or 0  # type: ignore[index]
    dealt = names.select("norm_name", "syn_id").repartition(max(1, math.ceil(chars / CHARS_A_TASK)), "syn_id")
    return dealt.select(F.explode(qgrams(F.col("norm_name"), q)).alias("qgram"), "syn_id").groupBy("qgram", "syn_id").agg(F.count(F.lit(1)).alias("freq"))


def candidates(postings: DataFrame, prefix: str, q: int = 3) -> DataFrame:
    """(syn_id, freq): the summed frequencies of the q-grams that prefix and name share, a repeated q-gram of prefix counting each time."""
    bag = Counter(qgrams_of(prefix, q))
    if not bag:
        return postings.select("syn_id", "freq").limit(0)
    weight = F.lit(0)
    for gram, n in sorted(bag.items()):
        weight = F.when(F.col("qgram") == gram, F.lit(n)).otherwise(weight)
    return postings.where(F.col("qgram").isin(list(bag))).groupBy("syn_id").agg(F.sum(weight * F.col("freq")).alias("freq"))


def verified(found: DataFrame, names: DataFrame, prefix: str, delta: int, q: int = 3) -> DataFrame:
    """(syn_id, ent_id, name, ped): candidates with enough common q-grams and a distance of at most delta."""
    threshold = len(prefix) - q * delta
    if threshold <= 0:
        raise ValueError("delta is too large for the prefix: every name would be a candidate")
    near = found.where(F.col("freq") >= threshold).join(names, "syn_id")
    return near.select("syn_id", "ent_id", "name", prefix_distance(F.lit(prefix), F.col("norm_name"), delta).alias("ped")).where(F.col("ped") <= delta)


def find_matches(postings: DataFrame, names: DataFrame, entities: DataFrame, prefix: str, delta: int | None = None, q: int = 3, k: int | None = None) -> DataFrame:
    """(ent_id, syn_id, ped, score): each entity once by its nearest name, by distance, then score descending, then id. prefix is normalized already."""
    delta = delta_for(prefix, q) if delta is None else delta
    near = verified(candidates(postings, prefix, q), names, prefix, delta, q)
    best = near.groupBy("ent_id").agg(F.min(F.struct("ped", "syn_id")).alias("best"))
    out = best.select("ent_id", F.col("best.syn_id").alias("syn_id"), F.col("best.ped").alias("ped")).join(entities.select("ent_id", "score"), "ent_id")
    out = out.orderBy("ped", F.desc("score"), "ent_id")
    return out if k is None else out.limit(k)


def match_stats(postings: DataFrame, names: DataFrame, prefix: str, delta: int, q: int = 3) -> DataFrame:
    """One row: lists merged, candidates, distances computed, matches."""
    found = candidates(postings, prefix, q)
    tried = found.where(F.col("freq") >= len(prefix) - q * delta)
    near = verified(found, names, prefix, delta, q)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    lists = one(postings.where(F.col("qgram").isin(sorted(set(qgrams_of(prefix, q))))).select("qgram").distinct(), "lists")
    return lists.crossJoin(one(found, "candidates")).crossJoin(one(tried, "distances")).crossJoin(one(near, "matches"))  # four rows of one


def infos(entities: DataFrame, names: DataFrame, syn_id: int | Column) -> DataFrame:
    """(syn_id, synonym, name, score, info); no row for an unknown id."""
    chosen = names.where(F.col("syn_id") == syn_id).select("syn_id", "ent_id", F.col("name").alias("synonym"))
    return chosen.join(entities, "ent_id").select("syn_id", "synonym", "name", "score", "info")
