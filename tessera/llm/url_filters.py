"""URL filters by host-suffix and path-prefix expressions.

Each distinct (host, path) expands into expressions: every host suffix on a label boundary that is as short as some
rule's host, times every path prefix that is as long as some rule's path. An equi-join on the first 32 bits of the
expressions' SHA-256 finds candidate rules, equal full digests confirm them, and the longest rule wins. Only DataFrame
functions are used.

Null urls and urls without `://` have empty host and path, and no rule fits; they are spread over SALTS keys of the last join.
Urls of any length are tried whole. Of rules of one length that fit, the one with the longer host wins, which settles all
ties. Repeated rows stay repeated; extra columns stay, but for those named host, path, rule or verdict, which are replaced.
Rules with a null field are ignored; of equal rules with different verdicts the block wins. An empty table gives an empty
table, and without rules every verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, without

#: Rules up to this many are broadcast; beyond it the join shuffles on the hash prefix.
BROADCAST_RULES = 200_000
PREFIX_HEX = 8
SALTS = 64


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def classify(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (`host/path` of the longest fitting rule, or null) and verdict.

    rules has string columns host, path (beginning with `/`) and verdict.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).dropna()
    rules = rules.groupBy("h", "p").agg(F.max("v").alias("v"))
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("h", r"\."))).alias("labels"), F.array_sort(F.collect_set(F.length("p"))).alias("lengths")).first()
    base = without(pages, ["host", "path", "rule", "verdict", "__salt"]).select("*", host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = base.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    if not shape["n"]:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(shape["labels"]))), lambda k: F.concat_ws(".", F.slice(parts, F.size(parts) - k + 1, k)))
    lengths = F.filter(F.array(*(F.lit(n) for n in shape["lengths"])), lambda n: n <= F.length("path"))
    keys = base.where("host <> ''").select("host", "path").distinct()
    tried = keys.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(lengths).alias("n"))
    tried = tried.select("host", "path", F.sha2(F.concat("suffix", F.substring("path", F.lit(1), F.col("n"))), 256).alias("digest"))
    tried = tried.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    coded = rules.select(F.concat("h", "p").alias("rule"), F.length("h").alias("h_length"), F.col("v").alias("verdict")).withColumn("full", F.sha2("rule", 256))
    coded = coded.withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    coded = F.broadcast(coded) if shape["n"] <= BROADCAST_RULES else coded
    best = tried.join(coded, "prefix").where(F.col("digest") == F.col("full"))
    best = best.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "h_length")).alias("best"))
    cols = [F.col(f"`{c}`") for c in base.columns if c not in ("host", "path")]
    salt = F.when(F.col("host") == "", 1 + F.pmod(F.xxhash64(*cols), F.lit(SALTS))).otherwise(F.lit(0))
    best = best.withColumn("__salt", F.lit(0).cast("long"))
    return base.withColumn("__salt", salt).join(best, ["host", "path", "__salt"], "left").select(*cols, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
