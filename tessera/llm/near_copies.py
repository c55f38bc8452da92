"""One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more, by sampled SimHash.

At this similarity whole-document fingerprints differ in up to a quarter of their bits, too many for a grid. So each
document has SAMPLES fingerprints, each the SimHash of ROWS shingles that consistent (min-wise) sampling picks: two texts
of similarity s have equal ones with probability s ** ROWS each. They map to their segment counts as in `simhash`, an
equi-join on those counts is the grid join at distance 0, and the shingle sets of the pairs are compared exactly. A pair
of similarity 0.8 is met with probability 1 - (1 - 0.8 ** 5) ** 16 = 0.998, more similar ones oftener; no pair below
0.8 is linked. What this leaves is found without loss by `remainder`.

Pairs are compared in two steps. A text's parity bits have a 1 where an odd number of its shingles fall; the bits in which
two texts' parities differ are never more than the shingles that only one of them has, so most pairs are ruled out by a few
bytes for each hundred words. Only the others' texts are fetched.

Equal word sequences (A-Z lower-cased) are one text, told apart by 64-bit hashes. Texts of fewer words than a shingle
have one shingle of all their words; null, empty and wordless texts are one group. The texts of a cell are compared with
the one that meets most texts in all its cells. In cells of over CELL_LIMIT texts that this leaves in several components
others take its place, as long as links are found so, PIVOTS texts at most: this finds most links at little cost.
All texts are then met again by their rare shingles: in any order of all shingles, here the rarest first, the first fifths
of two similar sets have one in common, so an equi-join on those loses no pair. Most of these shingles are in one text
only; `shared` finds the others from sorted, packed parts of them. Only pairs that no chain of links joins yet are compared.

Repeated rows count as copies: one stays. Rows without an id are never smallest; one row of each distinct text among them
stays. An empty table gives an empty table. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from .common import give_back, map_columns, scratch, slices, stored
from .components import components
from .simhash import SEED, embedding

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, ROWS = 16, 5
CELL_LIMIT, PIVOTS = 64, 16
#: One pair in so many has to be a link, or no further text of a cell is compared with the others.
LEAST_YIELD = 8
#: Of the 80 sampled shingles' low bytes, pairs of similarity 0.8 agree in 64 on average, with a deviation of 3.6. The grid's
#: pairs that agree in fewer are left to `remainder`, which doesn't look at them.
LEAST_AGREEING = 50
#: The order of shingles in `prefix` is by their counts in one text of ORDER_PART, of at most ORDER_LIMIT shingles.
ORDER_PART, ORDER_LIMIT = 64, 20_000
#: Rows that are copies of others are broadcast up to so many.
BROADCAST_COPIES = 1_000_000
#: Shingles of prefixes are met by CELL_BYTES bytes of their hashes, in parts of about PART_CELLS.
CELL_BYTES, PART_CELLS = 5, 250_000
#: In cells of up to so many texts, those are left out that no other text there can be similar to by its size and place.
NEAR = 16
_RNG = np.random.default_rng(7)
_ODD = _RNG.integers(0, 1 << 63, SAMPLES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, SAMPLES * ROWS, dtype=np.uint64)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The distinct XXH64 of the word shingles, ascending."""
    import xxhash

    k = min(SHINGLE, len(words))
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)} if words else {0}), np.uint64)


def sample(hashes: np.ndarray) -> np.ndarray:
    """For each of SAMPLES x ROWS permutations the hash that comes first."""
    best, found = None, None
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        order = (part[:, None] ^ _MIX) * _ODD
        at = order.argmin(0)
        least = order[at, np.arange(len(_ODD))]
        if best is None:
            best, found = least, part[at]
        else:
            found = np.where(least < best, part[at], found)
            best = np.minimum(least, best)
    return found


def fingerprints(sampled: np.ndarray) -> np.ndarray:
    """The SimHash of each run of ROWS sampled hashes."""
    bits = np.unpackbits(sampled.astype(">u8").view(np.uint8).reshape(SAMPLES, ROWS, 8), axis=2)
    return np.packbits(2 * bits.sum(1, dtype=np.int64) > ROWS, axis=1).view(">i8").ravel().astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def parity(hashes: np.ndarray) -> bytes:
    """The parity bits of the shingles: at least two bits for each, a power of two of them."""
    width = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two texts only."""
    x, y = (np.frombuffer(bits, np.uint8) for bits in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum(dtype=np.int64))


def most_difference(sizes: int) -> int:
    """At most so many shingles are in one of two similar texts only, of sizes shingles together."""
    return int(sizes * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6)


def _mark(common: tuple[np.ndarray, np.ndarray]):
    import xxhash

    at = TaskContext.get().partitionId() << 40

    def run(texts: pa.Array):
        nonlocal at
        ids, prints, bytes_, bits, sizes, firsts = [], [], [], [], [], []
        for text in texts.to_pylist():
            words = (text or "").encode().lower().split()
            hashes = shingle_hashes(words)
            sizes.append(len(hashes))
            firsts.append(packed_cells(prefix(hashes, common)))
            ids.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63))
            sampled = sample(hashes)
            prints.append(fingerprints(sampled))
            bytes_.append(sampled.astype(np.uint8).tobytes())
            bits.append(parity(hashes))
        at += len(ids)
        row = pa.array(np.arange(at - len(ids), at, dtype=np.int64))
        return [row, pa.array(ids, pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array(bytes_, pa.binary()), pa.array(bits, pa.binary()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.binary())]

    return run


def packed_cells(hashes: np.ndarray) -> bytes:
    """The first CELL_BYTES bytes of each hash."""
    return np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :CELL_BYTES].tobytes()


def cells_of(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // CELL_BYTES, 8), np.uint8)
    wide[:, 8 - CELL_BYTES :] = np.frombuffer(packed, np.uint8).reshape(-1, CELL_BYTES)
    return wide.view(">u8").ravel().astype(np.int64)


def _agree(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SAMPLES * ROWS) for c in ("sa", "sb"))
        yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(1) >= LEAST_AGREEING))


def _close(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([least_difference(x, y) <= most_difference(m + n) for x, y, m, n in rows], pa.bool_()))


def _similar(batches):
    for batch in batches:
        known: dict[str, np.ndarray] = {}
        hashed = lambda t: known[t] if t in known else known.setdefault(t, shingle_hashes((t or "").encode().lower().split()))  # noqa: E731, B023
        same = []
        for a, b in zip(batch.column("ta"), batch.column("tb")):
            same.append(similarity(hashed(a.as_py()), hashed(b.as_py())) >= SIMILARITY)
            if len(known) > 256:
                known.clear()
        yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))
        del known
        give_back()


def _ends(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of reps(v) that are in pairs(a, b)."""
    named = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    return stored(reps.join(stored(named, "named"), "v", "left_semi"), "ends")


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sampled shingles agree often enough."""
    ends = _ends(pairs, reps.select("v", "bytes"))
    sides = [ends.select(F.col("v").alias(c), F.col("bytes").alias(f"s{c}")) for c in "ab"]
    return stored(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb").mapInArrow(_agree, "a long, b long"), "agreeing")


def _verified(pairs: DataFrame, reps: DataFrame, light: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that are similar enough."""
    ends = _ends(pairs, reps.select("v", "bits", "size"))
    sides = [ends.select(F.col("v").alias(c), F.col("bits").alias(f"s{c}"), F.col("size").alias(f"n{c}")) for c in "ab"]
    likely = stored(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_close, "a long, b long"), "likely")
    wanted = _ends(likely, reps.select("v", "raw"))
    texts = stored(light.select(_raw().alias("raw"), "text").join(wanted, "raw").groupBy("v").agg(F.first("text").alias("text")), "texts")
    sides = [texts.select(F.col("v").alias(c), F.col("text").alias(f"t{c}")) for c in "ab"]
    return stored(likely.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ta", "tb").mapInArrow(_similar, "a long, b long"), "similar")


def _raw():
    """What tells texts apart as they are."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def commoner(light: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, counts): those that repeat among one text in ORDER_PART, the commonest. Only the order of `prefix` rests on them."""
    part = light.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ORDER_PART)) == 0).distinct()
    counted = part.mapInArrow(_shingled, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "h").limit(ORDER_LIMIT).collect()
    names = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.array([r["n"] for r in rows], np.int64)[order]


def _shingled(batches):
    for batch in batches:
        for text in batch.column("text"):
            hashes = shingle_hashes((text.as_py() or "").encode().lower().split()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes)], names=["h"])


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first fifth of the shingles, rarest first: two sets of SIMILARITY have one in common, whatever the order, if it is one for all."""
    names, counts = common
    weight = np.zeros(len(hashes), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        weight = np.where(names[at] == hashes, counts[at], 0)
    n = len(hashes)
    return hashes[np.argsort(weight, kind="stable")][: n - int(np.ceil(n * SIMILARITY - 1e-9)) + 1]


def _dealt(parts: int):
    """Prefixes as (part, chunk, cells): the cells of a chunk of rows that fall into a part, packed by `packed`."""

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        prefixes = piece.column("prefix").to_pylist()
        cells, sizes = cells_of(b"".join(prefixes)), np.array([len(x) // CELL_BYTES for x in prefixes], np.int64)
        rows = np.repeat(piece.column("row").to_numpy(), sizes)
        at = np.arange(len(cells)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        step = (at * 256 // np.repeat(sizes, sizes)).astype(np.uint8)
        scale = np.repeat(size_class(piece.column("size").to_numpy()), sizes)
        order = np.lexsort((cells, rows >> 16))
        cells, rows, step, scale = (x[order] for x in (cells, rows, step, scale))
        part, chunk = cells * parts >> 8 * CELL_BYTES, rows >> 16
        starts = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(chunk) != 0)])
        made = [packed(cells[i:j], rows[i:j], step[i:j], scale[i:j]) for i, j in zip(starts, [*starts[1:], len(cells)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int64()), pa.array(chunk[starts], pa.int64()), pa.array(made, pa.binary())], names=["part", "chunk", "cells"])

    def run(batches):
        for batch in batches:
            yield from map(one, slices(batch, 1, 1 << 20))
            del batch
            give_back()

    return run


def size_class(sizes: np.ndarray) -> np.ndarray:
    """Sixteenths of the sizes' binary logarithm; 255 for all beyond."""
    return np.minimum(np.floor(16 * np.log2(sizes) + 1e-9), 255).astype(np.uint8)


def may_suffice(step: np.ndarray, scale: np.ndarray, other: np.ndarray) -> np.ndarray:
    """False only where what follows a shingle in a prefix is too little for a similar text of the other size class."""
    ratio = 2.0 ** ((other.astype(np.int64) - scale - 1) / 16)  # the other text is larger by more than this
    return (1 - step / 256 * (1 - SIMILARITY) >= (1 + ratio) * SIMILARITY / (1 + SIMILARITY) - 1e-6) | (scale == 255) | (other == 255)


def packed(cells: np.ndarray, rows: np.ndarray, step: np.ndarray, scale: np.ndarray) -> bytes:
    """The differences of ascending cells, the rows within the chunk, the steps and size classes, byte by byte."""
    wide = np.diff(cells, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CELL_BYTES].T
    return np.ascontiguousarray(wide).tobytes() + (rows & 0xFFFF).astype("<u2").tobytes() + step.tobytes() + scale.tobytes()


def unpacked(chunk: int, made: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, rows, steps, size classes) of a chunk."""
    n = len(made) // (CELL_BYTES + 4)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :CELL_BYTES] = np.frombuffer(made, np.uint8, n * CELL_BYTES).reshape(CELL_BYTES, n).T
    rows = np.frombuffer(made, "<u2", n, n * CELL_BYTES).astype(np.int64) + (chunk << 16)
    return wide.view("<u8").ravel().astype(np.int64).cumsum(), rows, *np.frombuffer(made, np.uint8, 2 * n, n * (CELL_BYTES + 2)).reshape(2, n)


def met(cells: np.ndarray, steps: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Whether another entry has the same of the ascending cells and may be of a similar text. All entries of cells of over NEAR pass."""
    keep = np.zeros(len(cells), bool)
    for d in range(1, NEAR + 1):
        i = np.flatnonzero(cells[d:] == cells[:-d])
        if d < NEAR:
            i = i[may_suffice(steps[i], scales[i], scales[i + d]) & may_suffice(steps[i + d], scales[i + d], scales[i])]
            keep[i] = keep[i + d] = True
        else:
            for k in range(NEAR + 1):
                keep[i + k] = True
    return keep


def _met(group: pa.Table) -> pa.Table:
    """(cell, row, step) of the entries of a part that meet others."""
    found = [unpacked(c, x) for c, x in zip(group.column("chunk").to_pylist(), group.column("cells").to_pylist(), strict=True)]
    cells, rows, steps, scales = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    keep = met(cells, steps[order], scales[order])
    order = order[keep]
    made = pa.table({"cell": cells[keep], "row": rows[order], "step": steps[order].astype(np.int64)})
    del cells, rows, steps, scales, order
    give_back()
    return made


def shared(reps: DataFrame) -> DataFrame:
    """(cell, row, step) of reps(row, prefix, size): the shingles of prefixes by which texts meet others that they may be similar to.

    step: 256ths of the prefix before it.
    """
    total = reps.agg(F.sum(F.length("prefix"))).first()[0] or 0
    parts = max(1, total // CELL_BYTES // PART_CELLS)
    dealt = reps.select("row", "prefix", "size").mapInArrow(_dealt(parts), "part long, chunk long, cells binary")
    return dealt.groupBy("part").applyInArrow(_met, "cell long, row long, step long")


def _topped(members: DataFrame) -> DataFrame:
    """The members(cell, root) of cells with several roots, with the commonest root of the cell as top."""
    mixed = members.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    members = stored(members.join(mixed, "cell"), "mixed")
    top = members.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("top"))
    return stored(members.join(top, "cell"), "topped")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("v_a", "v_b").alias("a"), F.greatest("v_a", "v_b").alias("b")).distinct()


def _rooted(df: DataFrame, found: DataFrame) -> DataFrame:
    """df(v) with the root of v's component by the links found."""
    return df.join(components(found).withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))


def remainder(found: DataFrame, reps: DataFrame, light: DataFrame) -> DataFrame:
    """(a, b): the similar pairs of reps(row, v, size, prefix, bits) that the links found leave in two components, without loss.

    Pairs meet by a shingle that both have in their prefixes. A cell whose texts are all in one component has nothing to
    add; in the others each text outside the cell's largest component is compared with all texts of other components. A
    pair is passed on only if what follows the shingle it meets by suffices for SIMILARITY: similar pairs do so at the
    first one they share.
    """
    rooted = stored(_rooted(reps.select("row", "v", "size", F.length("prefix").alias("long")), found), "rooted")
    # a step is rounded down, so at least as much follows as is left
    left = F.col("size") - F.ceil(F.col("step") * (F.col("long") / CELL_BYTES) / 256)
    cells = stored(stored(shared(reps), "shared").join(rooted, "row").select("cell", "v", "size", "root", left.alias("left")), "cells")
    enough = F.least("left_a", "left_b") >= F.ceil((F.col("size_a") + F.col("size_b")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    members = _topped(cells)
    a, b = (members.select("cell", "top", *(F.col(c).alias(f"{c}_{side}") for c in ("v", "size", "root", "left"))) for side in "ab")
    both = a.where("root_a <> top").join(b.drop("top"), "cell").where("root_a <> root_b and (root_b = top or v_a < v_b)")
    return _verified(stored(_ordered(both.where(enough)), "across"), reps, light)


def links(reps: DataFrame, light: DataFrame) -> DataFrame:
    """(a, b): enough pairs of similar texts of reps(row, v, raw, prints, bytes, bits, size, prefix) to connect each group."""
    members, cell = reps.select("v", F.posexplode(F.transform("prints", embedding)).alias("grid", "cell")), ["grid", "cell"]
    sizes = stored(members.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    members, found = stored(members.join(sizes, cell), "sized"), None
    central = members.groupBy("v").agg(F.sum("n").alias("met"))
    members = stored(members.join(central, "v").withColumn("root", F.col("v")), "members")
    for turn in range(PIVOTS):
        first = F.max_by(F.struct("v", "root"), F.struct("met", F.xxhash64("v")) if turn == 0 else F.xxhash64(F.lit(turn), "v")).alias("p")
        firsts = members.groupBy(cell).agg(first, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(*cell, F.col("p.v").alias("v_b"), F.col("p.root").alias("root_b"))
        pairs = stored(_ordered(members.withColumnRenamed("v", "v_a").join(stored(firsts, "firsts"), cell).where("root <> root_b")), "pairs")
        new = _verified(_agreeing(pairs, reps), reps, light)
        found = new if found is None else stored(found.unionByName(new), "found")
        members = members.where(F.col("n") > CELL_LIMIT)
        if new.count() * LEAST_YIELD < pairs.count() or members.isEmpty():
            break
        members = stored(_rooted(members.drop("root"), found), "members")
    return found.unionByName(remainder(found, reps, light))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, v, class_id) for every row: the hash of its text and the least id among its near copies, linked by any chain."""
    light = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = [StructField("row", LongType(), False), StructField("v", LongType(), False), StructField("prints", ArrayType(LongType()), False), StructField("bytes", BinaryType(), False), StructField("bits", BinaryType(), False), StructField("size", LongType(), False), StructField("prefix", BinaryType(), False)]
    common = commoner(light)
    marked = stored(map_columns(light.withColumn("raw", _raw()), ["text"], made, lambda: _mark(common), ("text",)), "marked")
    copies = marked.groupBy("v").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = stored(marked.select("row", "v").join(copies, "v").where("row <> first").select("row"), "copies")
    if copies.count() <= BROADCAST_COPIES:
        reps = marked.join(F.broadcast(copies), "row", "left_anti")
    else:
        reps = stored(marked.join(copies, "row", "left_anti"), "distinct")
    rooted = components(links(reps, light)).withColumnRenamed("node", "v")
    least = marked.groupBy("v").agg(F.min("id").alias("least"))
    placed = stored(least.join(rooted, "v", "left").select("v", "least", F.coalesce("root", "v").alias("root")), "placed")
    groups = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    named = stored(placed.join(groups, "root").select("v", "class_id"), "classes")
    return marked.select("id", "v").join(named, "v").select("id", "v", "class_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their group; of repeated rows one stays, and of rows without an id one of each distinct text."""
    with scratch(docs.sparkSession):
        kept = classes(docs, id_col, text_col).where("id = class_id")
        counted = stored(kept.groupBy(F.col("id").alias("__kept")).agg(F.count(F.lit(1)).alias("n")), "kept", keep=True)
    chosen = lambda which: docs.join(counted.where(which), F.col(f"`{id_col}`") == F.col("__kept"), "left_semi")
    nameless = docs.where(F.col(f"`{id_col}`").isNull()).dropDuplicates([text_col])
    return chosen("n = 1").unionByName(chosen("n > 1").dropDuplicates()).unionByName(nameless)
