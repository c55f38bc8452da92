"""Benchmark decontamination by a distributed positional inverted index.

The index holds a posting (document key, term, position) for every occurrence in the documents of a term of the test
items, and is stored in the shared folder. For each window of an item the offset-adjusted posting lists of its two rarest
terms are intersected in one aggregation by (document, item, alignment); the survivors are then compared word by word with
the document. Only DataFrame functions are used.

Items are handled in segments of SEGMENT windows, so that the work on a long item grows with its length only.

Null or wordless texts have no words: nothing hits them. Items without an id hit words like any other, but n_items and
items_sha256 count and list ids only. Repeated documents each get their row, repeated items count once. Extra columns stay,
but for those with an output's name, which are replaced. Very long texts are handled whole. An empty document table gives an
empty result, an empty item table gives n_hit 0 everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, scratch, stored, without

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENT = 64
#: Sizes up to which the small side is broadcast; beyond them the joins shuffle.
BROADCAST_TERMS = 500_000
BROADCAST_CANDIDATES, BROADCAST_CANDIDATE_WORDS = 50_000, 2_000_000
OUTPUTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _small(df: DataFrame, n: int, limit: int) -> DataFrame:
    return F.broadcast(df) if n <= limit else df


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A key for each row; equal keys of different rows cost a comparison, never a wrong hit."""
    return docs.withColumn("__key", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))


def item_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, id, iwords): item names the row within this module, also where the id is null."""
    items = items.select(F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`")).alias("iwords")).where("size(iwords) > 0").distinct()
    return items.select(F.xxhash64(F.col("id").isNull(), "id", "iwords").alias("item"), "id", "iwords")


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(terms, postings): terms(term, word, freq) of the items, postings(key, term, at) of all documents, both stored."""
    words = stored(items.select(F.explode("iwords").alias("word")).distinct().withColumn("term", F.xxhash64("word")), "terms")
    n = words.count()
    tokens = _keyed(docs, id_col, text_col).select(F.col("__key").alias("key"), F.posexplode(words_of(F.col(f"`{text_col}`"))).alias("at", "word"))
    postings = stored(tokens.join(_small(words, n, BROADCAST_TERMS), "word").select("key", "term", "at"), "postings")
    freq = postings.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    terms = words.join(freq, "term", "left").select("term", "word", F.coalesce("freq", F.lit(0)).alias("freq"))
    return stored(terms, "frequencies"), postings


def windows_of(items: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, id, seg, base, iwords, spots, wins): a segment's first word, its words and their terms, and its windows.

    A window has its first word j, its length n and the item positions a, b of its two rarest terms.
    """
    spots = items.select("item", "id", "iwords", F.posexplode("iwords").alias("p", "word")).join(terms, "word")
    ranked = spots.groupBy("item", "id", "iwords").agg(F.array_sort(F.collect_list(F.struct("p", "freq", "term"))).alias("spots"))
    ranked = ranked.withColumn("n", F.least(F.size("iwords"), F.lit(window))).withColumn("last", F.size("iwords") - F.col("n"))
    parts = ranked.withColumn("seg", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / SEGMENT).cast("int")))).withColumn("base", F.col("seg") * SEGMENT)
    own = lambda c: F.slice(c, F.col("base") + 1, F.col("n") + (SEGMENT - 1)).alias(c)
    parts = parts.select("item", "id", "seg", "base", "n", "last", own("iwords"), own("spots"))

    def one(j: Column) -> Column:
        rare = F.array_sort(F.transform(F.slice("spots", j - F.col("base") + 1, F.col("n")), lambda s: F.struct(s["freq"].alias("freq"), s["p"].alias("p"))))
        return F.struct(j.alias("j"), F.col("n").alias("n"), rare[0]["p"].alias("a"), F.try_element_at(rare, F.when(F.col("n") > 1, F.lit(2)).otherwise(F.lit(1)))["p"].alias("b"))

    firsts = F.sequence(F.col("base"), F.least(F.col("base") + (SEGMENT - 1), F.col("last")))
    return parts.select("item", "id", "seg", "base", "iwords", "spots", F.transform(firsts, one).alias("wins"))


def candidates(postings: DataFrame, wins: DataFrame, n_terms: int) -> DataFrame:
    """(key, id, base, iwords, delta, wins): alignments in which some windows have both rarest terms at their places."""
    anchors = wins.select("item", "seg", "base", "spots", F.explode(F.array_distinct(F.flatten(F.transform("wins", lambda w: F.array(w["a"], w["b"]))))).alias("p"))
    anchors = anchors.select("item", "seg", "p", F.expr("spots[p - base].term").alias("term")).distinct()
    lists = postings.join(_small(anchors, n_terms, BROADCAST_TERMS), "term").select("key", "item", "seg", (F.col("at") - F.col("p")).alias("delta"), "p")
    met = lists.groupBy("key", "item", "seg", "delta").agg(F.collect_set("p").alias("met"))
    joined = met.join(_small(wins.select("item", "seg", "id", "base", "iwords", "wins"), n_terms, BROADCAST_TERMS), ["item", "seg"])
    left = F.filter("wins", lambda w: F.array_contains("met", w["a"]) & F.array_contains("met", w["b"]) & (F.col("delta") + w["j"] >= 0))
    return joined.select("key", "id", "base", "iwords", "delta", F.transform(left, lambda w: F.struct(w["j"].alias("j"), w["n"].alias("n"))).alias("wins")).where("size(wins) > 0")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and spans (array of item, first word, words)."""
    docs = without(docs, [*OUTPUTS, "spans", "__key", "__found"])
    with scratch(docs.sparkSession):
        items = stored(item_table(benchmark), "items")
        terms, postings = build_index(docs, items, id_col, text_col)
        n_terms = items.select(F.coalesce(F.sum(F.size("iwords")), F.lit(0))).first()[0]
        found = candidates(postings, stored(windows_of(items, terms, window), "windows"), n_terms)
        found = stored(found.groupBy("key").agg(F.collect_list(F.struct("id", "base", "iwords", "delta", "wins")).alias("__found")), "candidates", keep=True)
    words = F.aggregate("__found", F.lit(0), lambda n, f: n + F.size(f["iwords"]))
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(words), F.lit(0)).alias("words")).first()
    found = _small(found, size["n"], BROADCAST_CANDIDATES if size["words"] <= BROADCAST_CANDIDATE_WORDS else -1)

    keyed = _keyed(docs, id_col, text_col).join(found.withColumnRenamed("key", "__key"), "__key", "left").withColumn("__words", words_of(F.col(f"`{text_col}`")))
    exact = F.expr(
        "flatten(transform(coalesce(__found, array()), f -> transform(filter(f.wins, w -> slice(__words, f.delta + w.j + 1, w.n) = slice(f.iwords, w.j - f.base + 1, w.n)),"
        " w -> named_struct('item', f.id, 'first', f.delta + w.j, 'words', w.n))))"
    )
    keyed = keyed.withColumn("spans", exact)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["words"] - 1))))).cast("long")
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform("spans", lambda s: s["item"].cast("string")))))
    made = keyed.select(*(F.col(f"`{c}`") for c in docs.columns), F.size("__words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "spans")
    return made.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, item, first, words): windows whose every term lies within slop words of its place relative to the rarest one.

    key is xxhash64 of the document's id and text. slop 0 gives the exact matches. Anchors and the other terms meet by
    buckets of slop + 1 alignments, so each posting is sent to three buckets at most.
    """
    items = stored(item_table(benchmark), "items")
    terms, postings = build_index(docs, items, id_col, text_col)
    wins = stored(windows_of(items, terms, window), "windows")
    flat = wins.select("item", "base", "spots", F.explode("wins").alias("w")).select("item", F.col("w.j").alias("j"), F.col("w.n").alias("n"), F.col("w.a").alias("a"), F.expr("slice(spots, w.j - base + 1, w.n)").alias("need"))
    width = slop + 1
    spots = flat.select("item", "j", "n", "a", F.explode("need").alias("s")).select("item", "j", "n", "a", F.col("s.p").alias("p"), F.col("s.term").alias("term"))
    lists = postings.join(spots, "term").select("key", "item", "j", "n", "a", "p", (F.col("at") - F.col("p")).alias("delta"))
    anchor = lists.where("p = a").select("key", "item", "j", "n", F.col("delta").alias("at"), F.explode(F.array(*(F.floor(F.col("delta") / width) + d for d in (-1, 0, 1)))).alias("bucket"))
    rest = lists.select("key", "item", "j", "p", "delta", F.floor(F.col("delta") / width).alias("bucket"))
    met = anchor.join(rest, ["key", "item", "j", "bucket"]).where(F.abs(F.col("delta") - F.col("at")) <= slop)
    met = met.groupBy("key", "item", "j", "n", "at").agg(F.count_distinct("p").alias("got")).where("got = n")
    return met.join(items.select("item", "id"), "item").select("key", F.col("id").alias("item"), (F.col("at") + F.col("j")).alias("first"), F.col("n").alias("words"))
