"""SimHash near-duplicates by segment-popcount embedding.

A document's fingerprint has the bits that are set in over half of its word shingles' XXH64. Fingerprints map to the
counts of set bits in 32 segments of two bits, held in unary code, so that the Manhattan distance of two count vectors, never
more than the Hamming distance of the fingerprints, is the number of differing code bits. The segments are cut into
bits // 2 + 1 groups; vectors within Manhattan distance `bits` are within distance 1 in one group at least. Each group's
counts are a cell of a grid, and a range join meets every near pair: a fingerprint probes its own cell and those with one
count raised by one (the pair's other side probes downwards). The Manhattan bound, then the exact distance, filter.

In a cell where more than CELL_LIMIT ** 2 pairs would meet nothing is paired. For the members of such cells, points within
1 bit of one fingerprint and within bits - 1 of others link all of those to it, exactly and in as many rows as members.

Null, empty and wordless texts have fingerprint zero and are linked like any other. Texts of fewer words than a shingle
have one shingle of all their words. A null id is never smallest; a class of null ids only has a null class id. Repeated
rows and extra columns are kept; columns with an output's name are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from .common import map_columns, scratch, stored, without
from .components import components

SHINGLE, BITS, SEED = 3, 3, 42
CELL_LIMIT = 256
_LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, k = [0, *ends[:-1].tolist()], min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), ">u8", len(words) - k + 1)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, out: str = "bits", keep_text: bool = True) -> DataFrame:
    """docs with the fingerprint as a signed long."""

    def make():
        def run(texts: pa.Array):
            found = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64)
            return [pa.array(found.view(np.int64))]

        return run

    return map_columns(docs, [text_col], [StructField(out, LongType(), False)], make, () if keep_text else (text_col,))


def _lit(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def embedding(v: Column) -> Column:
    """The segment counts of fingerprint v in unary code: 00, 01 or 11 for each two bits."""
    up = F.shiftrightunsigned(v, 1)
    some, both = v.bitwiseOR(up).bitwiseAND(_lit(_LOW)), v.bitwiseAND(up).bitwiseAND(_lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def groups_of(bits: int = BITS) -> list[list[int]]:
    """The segments of each group."""
    n = bits // 2 + 1
    return [[s for s in range(32) if s * n // 32 == g] for g in range(n)]


def _cells(e: Column, bits: int) -> Column:
    """(grid, cell) of each group."""
    return F.array(*(F.struct(F.lit(g).alias("grid"), e.bitwiseAND(_lit(sum(3 << 2 * s for s in segments))).alias("cell")) for g, segments in enumerate(groups_of(bits))))


def _raised(e: Column, bits: int) -> Column:
    """(grid, cell) of each group with the count of one segment raised by one, for every segment that has room."""
    made = []
    for g, segments in enumerate(groups_of(bits)):
        cell = e.bitwiseAND(_lit(sum(3 << 2 * s for s in segments)))
        for s in segments:
            low, high = _lit(1 << 2 * s), _lit(2 << 2 * s)
            more = F.when(cell.bitwiseAND(low) == 0, cell.bitwiseOR(low)).when(cell.bitwiseAND(high) == 0, cell.bitwiseOR(high))
            made.append(F.when(more.isNotNull(), F.struct(F.lit(g).alias("grid"), more.alias("cell"))))
    return F.array_compact(F.array(*made))


def near_pairs(prints: DataFrame, bits: int = BITS, limit: int = CELL_LIMIT) -> DataFrame:
    """(a, b): fingerprints of prints(v, distinct) that differ in 1 to bits bits; of pairs within crowded cells, enough to connect the same fingerprints."""
    e = prints.select("v", embedding(F.col("v")).alias("e"))
    home = e.select("v", "e", F.inline(_cells(F.col("e"), bits)))
    raised = e.select("v", "e", F.inline(_raised(F.col("e"), bits)))
    probes = home.withColumn("up", F.lit(False)).unionByName(raised.withColumn("up", F.lit(True)))
    met = home.select("grid", "cell", F.lit(1).alias("h"), F.lit(0).alias("p")).unionByName(probes.select("grid", "cell", F.lit(0).alias("h"), F.lit(1).alias("p")))
    met = met.groupBy("grid", "cell").agg(F.sum("h").alias("h"), F.sum("p").alias("p"))
    crowded = stored(met.where(F.col("h") * F.col("p") > limit**2).select("grid", "cell"), "crowded")
    dense = None
    if not crowded.isEmpty():
        inside = lambda df: df.join(crowded, ["grid", "cell"], "left_semi").select("v")
        dense = stored(inside(home).unionByName(inside(raised)).distinct(), "dense")
        home, probes = (df.join(crowded, ["grid", "cell"], "left_anti") for df in (home, probes))
    a, b = probes.select("grid", "cell", F.col("v").alias("p"), F.col("e").alias("ep"), "up"), home.select("grid", "cell", F.col("v").alias("h"), F.col("e").alias("eh"))
    manhattan, hamming = F.bit_count(F.col("ep").bitwiseXOR(F.col("eh"))), F.bit_count(F.col("p").bitwiseXOR(F.col("h")))
    near = a.join(b, ["grid", "cell"]).where((F.col("up") | (F.col("p") < F.col("h"))) & (manhattan <= bits) & (hamming <= bits))
    pairs = near.select(F.least("p", "h").alias("a"), F.greatest("p", "h").alias("b")).distinct()
    return pairs if dense is None else pairs.unionByName(_dense_links(dense, bits))


def _dense_links(dense: DataFrame, bits: int) -> DataFrame:
    """Links that connect fingerprints of dense(v) within bits bits of each other, one for each point and fingerprint at most.

    Two such fingerprints have a point within 1 bit of one and bits - 1 of the other. All fingerprints within bits - 1 of
    a point are within bits of any fingerprint within 1 of it, so each is linked to the least of those.
    """
    if bits < 1:
        return dense.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0)
    near = F.array(_lit(0), *(_lit(1 << i) for i in range(64)))
    points = dense.select("v", F.explode(near).alias("m")).select("v", F.col("v").bitwiseXOR(F.col("m")).alias("point"))
    centre = points.groupBy("point").agg(F.min("v").alias("a"))
    reach = dense.select("v", F.col("v").alias("point"))
    for _ in range(bits - 1):
        reach = reach.select("v", "point", F.explode(near).alias("m")).select("v", F.col("point").bitwiseXOR(F.col("m")).alias("point")).distinct()
    return reach.join(centre, "point").where("a <> v").select("a", F.col("v").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, keep_text: bool = False) -> DataFrame:
    """docs with fingerprint (16 hex digits) and component_id, the smallest id among the documents linked to it by any chain."""
    docs = without(docs, ["fingerprint", "component_id", "__v"])
    marked = stored(with_fingerprints(docs, text_col, shingle, "__v", keep_text), "fingerprints")
    with scratch(docs.sparkSession):
        named = stored(_named(marked, id_col, bits), "classes", keep=True)
    digits = F.lower(F.lpad(F.hex("__v"), 16, "0"))
    return marked.join(named, "__v").select(*(F.col(f"`{c}`") for c in marked.columns if c != "__v"), digits.alias("fingerprint"), "component_id")


def _named(marked: DataFrame, id_col: str, bits: int) -> DataFrame:
    """(__v, component_id) of each fingerprint."""
    prints = stored(marked.groupBy(F.col("__v").alias("v")).agg(F.min(F.col(f"`{id_col}`")).alias("least")), "distinct")
    rooted = components(near_pairs(prints.select("v"), bits))
    placed = prints.join(rooted.withColumnRenamed("node", "v"), "v", "left").select("v", "least", F.coalesce("root", "v").alias("root"))
    linked = placed.join(rooted.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(least, "root", "left").select(F.col("v").alias("__v"), F.coalesce("component_id", "least").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The documents that are the smallest id of their class; of repeated rows one stays, and of classes without any id each distinct row."""
    light = classes(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col, shingle, bits)
    kept = stored(light.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("__kept")).agg(F.count(F.lit(1)).alias("n")), "kept")
    chosen = lambda which: docs.join(kept.where(which), F.col(f"`{id_col}`").eqNullSafe(F.col("__kept")), "left_semi")
    return chosen("n = 1").unionByName(chosen("n > 1").dropDuplicates())
