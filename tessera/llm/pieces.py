"""Encoding a corpus piece by piece: texts are cut where pre-tokens must end, and every distinct piece is encoded once.

1. Each slice of about SLICE_BYTES of text gives its distinct pieces, dealt by hash to buckets. A bucket meets all slices'
   copies of its pieces, so a piece is encoded once for the whole corpus. The ids go back to the slices, packed.
2. Each slice's texts become codes of its pieces, meet the pieces' ids, and the texts' ids are gathered.

There are BUCKETS buckets for each of the session's shuffle partitions, so both grow together. Pieces, codes and ids travel
packed and compressed; a slice, a bucket's share of one slice and one bucket are what a task holds at a time, and a single
longer text is a slice of its own. Nothing is kept between tasks or written besides the shuffles.

Both steps read the texts, so the rows must come in the same order twice: scans of files do. Any other input is stored
first. A slice is named by its texts' hash, and a slice without its ids raises an error.

A piece begins at a single space between two characters that aren't white space: byte-level pre-tokenizers take at most one
space with what follows it, and no token reaches from a character into the space after it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from .common import give_back, slices, stored

SLICE_BYTES = 16 << 20
BUCKETS = 4
#: encode(pieces) gives (ids, starts, sizes): where each piece's ids stand.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]

_WEIGHTS = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _plain_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The character that ends before each place is surely no white space or format mark."""
    last = data[at - 1]
    ok = (last > 0x20) & (last < 0x7F)
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        p = at[wide]
        two, three = data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
        short = (two >= 0xC3) & (two <= 0xDF)
        ok[wide] = short | (two < 0xC0) & ((three >= 0xE0) & _plain_triple(three, two, last[wide]) | (three < 0xC0) & (data[np.maximum(p - 4, 0)] >= 0xF0))
    return ok


def _plain_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same of the character that begins after each place."""
    first = data[at + 1]
    ok = (first > 0x20) & (first < 0x7F)
    wide = np.flatnonzero(first >= 0x80)
    if len(wide):
        p, top = at[wide], len(data) - 1
        lead = first[wide]
        ok[wide] = (lead >= 0xC3) & (lead <= 0xDF) | (lead >= 0xE0) & (lead < 0xF0) & _plain_triple(lead, data[np.minimum(p + 2, top)], data[np.minimum(p + 3, top)]) | (lead >= 0xF0)
    return ok


def _plain_triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Three-byte characters outside the blocks that hold white space and format marks."""
    odd = (a == 0xE1) & ((b == 0x9A) | (b == 0xA0))
    odd |= (a == 0xE2) & ((b == 0x81) | (b == 0x80) & ~((c >= 0x90) & (c <= 0xA7)))
    return ~(odd | (a == 0xE3) & (b == 0x80) | (a == 0xEF) & (b == 0xBB))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts in order, how many each text has). Joined they give the texts; null and empty texts have none."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if texts.buffers()[2] is None or bounds[-1] == bounds[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    spaces = np.flatnonzero(data == 0x20)
    spaces = spaces[(spaces > 0) & (spaces < len(data) - 1)]
    spaces = spaces[_plain_before(data, spaces) & _plain_after(data, spaces)]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    spaces = spaces[~edge[spaces + 1]]  # what follows a text's last space is another text
    edge[spaces] = True
    ends = np.flatnonzero(edge)
    counts = np.diff(np.searchsorted(ends, bounds))
    if len(data) >= 1 << 31:
        return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]), counts
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]), counts


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs flat[starts[i] : starts[i] + sizes[i]] for i in index, one after another; where each ends)."""
    n = sizes[index]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0], ends
    kind = np.int32 if max(int(ends[-1]), len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts[index] - (ends - n)).astype(kind), n)
    at += np.arange(len(at), dtype=kind)
    return flat[at], ends


def _squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _swollen(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values: np.ndarray) -> bytes:
    """Integers below 2 ** 32, their lowest bytes first, then their next ones."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return _squeezed(np.ascontiguousarray(planes).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_swollen(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _layout(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of an array of strings without nulls."""
    wide = pieces.cast(pa.large_string())
    bounds = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return bounds - bounds[0], data


def hashes_of(bounds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A 64-bit number for each string, equal for equal ones."""
    sizes = np.diff(bounds)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], sizes)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place & 255] * ((place >> 8).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    out = np.add.reduceat(terms, np.minimum(bounds[:-1], len(data) - 1))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def pack_pieces(pieces: pa.Array) -> bytes:
    bounds, data = _layout(pieces)
    return struct.pack("<I", len(pieces)) + _squeezed(np.diff(bounds).astype("<u4").tobytes() + data.tobytes())


def unpack_pieces(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes)."""
    (n,), raw = struct.unpack_from("<I", blob), _swollen(blob[4:])
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))]), np.frombuffer(raw, np.uint8)[4 * n :]


def _strings(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds.astype(np.int64))), pa.py_buffer(np.ascontiguousarray(data))])


def _buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ascending in the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _named(texts: pa.Array) -> int:
    """The hash of the texts."""
    import xxhash

    bounds, data = _layout(pa.compute.fill_null(texts, ""))
    h = xxhash.xxh3_64(np.ascontiguousarray(data))
    h.update(bounds.tobytes())
    return h.intdigest() - (1 << 63)


def _dealt(n_buckets: int):
    """Texts to (bucket, slice, pieces): a slice's distinct pieces in the order of their hashes, of which buckets are runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0, SLICE_BYTES):
                bounds, data = _layout(pa.compute.unique(cut(b.column(0))[0]))
                hashes = hashes_of(bounds, data)
                order = np.argsort(hashes, kind="stable")
                data, ends = gather(data, bounds[:-1], np.diff(bounds), order)
                bounds, of = np.concatenate([[0], ends]), _buckets_of(hashes[order], n_buckets)
                names, first = np.unique(of, return_index=True)
                last = np.append(first[1:], len(of))
                made = [pack_pieces(_strings(bounds[x : y + 1] - bounds[x], data[bounds[x] : bounds[y]])) for x, y in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([_named(b.column(0))] * len(names), pa.int64()), pa.array(made, pa.binary())], names=["bucket", "slice", "pieces"])
                give_back()

    return run


def _encoded(make: Callable[[], Encode]):
    """All rows (bucket, slice, pieces) of one bucket to (slice, bucket, ids): the sizes, then the ids of the slice's pieces."""
    held: list[Encode] = []

    def run(rows: pa.Table) -> pa.Table:
        if not held:
            held.append(make())
        parts = [unpack_pieces(b) for b in rows.column("pieces").to_pylist()]
        coded = pa.concat_arrays([_strings(*p) for p in parts]).dictionary_encode()
        flat, starts, sizes = held[0](coded.dictionary.to_pylist())
        index, at, made = coded.indices.to_numpy(), 0, []
        for bounds, _ in parts:
            own = index[at : at + len(bounds) - 1]
            at += len(own)
            made.append(struct.pack("<I", len(own)) + pack_ints(np.concatenate([sizes[own], gather(flat, starts, sizes, own)[0]])))
        del flat, index, coded, parts
        give_back()
        return pa.table({"slice": rows.column("slice"), "bucket": rows.column("bucket"), "ids": pa.array(made, pa.binary())})

    return run


_SCANS = re.compile(r"[\s:|+\-]*(?:\(\d+\) )?(?:Project|Filter|Relation|LocalRelation|Range)\b")


def _comes_alike(docs: DataFrame) -> bool:
    """The rows come in the same order whenever they are read: a scan, filtered or projected."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    return all(_SCANS.match(line) for line in plan.splitlines() if line.strip())


def encode_texts(docs: DataFrame, text_col: str, make: Callable[[], Encode], outputs: list[StructField], pack: Callable[[np.ndarray, np.ndarray], list[pa.Array]], keep_text: bool = True) -> DataFrame:
    """docs with the output columns that pack(ids, offsets) makes from its texts' ids. make() gives an encoder of pieces."""
    gone = {f.name.lower() for f in outputs} | ({text_col.lower()} if not keep_text else set())
    if all(c.lower() in gone for c in docs.columns):
        return encode_texts(docs.withColumn("__row", F.lit(None).cast(BooleanType())), text_col, make, outputs, pack, keep_text).drop("__row")
    if not _comes_alike(docs):
        docs = stored(docs, "texts")
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in docs.schema.fields]
    keep_at = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() not in gone]
    text_at = next(i for i, n in enumerate(names) if n.lower() == text_col.lower())
    own = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(kept)])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_at, SLICE_BYTES):
                pieces, counts = cut(b.column(text_at))
                made = pieces.dictionary_encode()
                codes, words = made.indices.to_numpy(), made.dictionary
                del pieces, made
                common = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # small numbers for them pack better
                rank, place = np.empty(len(words), np.int32), np.empty(len(words), np.int32)
                rank[common] = place[np.argsort(hashes_of(*_layout(words)), kind="stable")] = np.arange(len(words))
                rows = pa.StructArray.from_arrays([b.column(i) for i in keep_at], names=[f"c{i}" for i in range(len(keep_at))])
                blobs = [pa.array([pack_ints(x)], pa.binary()) for x in (rank[codes], counts, place[common])]
                yield pa.RecordBatch.from_arrays([pa.array([_named(b.column(text_at))], pa.int64()), *blobs, pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), rows)], names=["slice", "codes", "counts", "place", "rows"])
                del codes, words, rank, place, common, blobs
                give_back()

    n_buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(f"`{names[text_at]}`")).mapInArrow(_dealt(n_buckets), "bucket long, slice long, pieces binary")
    encoded = dealt.groupBy("bucket").applyInArrow(_encoded(make), "slice long, bucket long, ids binary")
    schema = StructType([*kept, *outputs])
    arrow = to_arrow_schema(schema)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        buckets, first = np.unique(right.column("bucket").to_numpy(), return_index=True)  # equal slices send the same
        runs, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in first.tolist():
            blob = right.column("ids")[i].as_py()
            (n,), x = struct.unpack_from("<I", blob), unpack_ints(blob[4:])
            sizes.append(x[:n].astype(np.int64))
            runs.append(x[n:])
        flat, size = np.concatenate(runs), np.concatenate(sizes)
        starts, made = np.cumsum(size) - size, []
        for k in range(left.num_rows):
            codes, counts, place = (unpack_ints(left.column(c)[k].as_py()) for c in ("codes", "counts", "place"))
            if len(place) != len(size):
                raise RuntimeError(f"a slice of {len(place)} pieces met the ids of {len(size)}: its rows came in another order")
            ids, ends = gather(flat, starts, size, place[codes])
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts.astype(np.int64))])]
            rows = left.column("rows").slice(k, 1).combine_chunks().flatten()
            made.append(pa.Table.from_arrays([*rows.flatten(), *pack(ids, offsets)], names=arrow.names).cast(arrow))
        del flat, size, starts, runs, sizes
        give_back()
        return pa.concat_tables(made) if made else arrow.empty_table()

    slices_ = docs.mapInArrow(coded, StructType.fromDDL("slice long, codes binary, counts binary, place binary").add("rows", ArrayType(own)))
    return slices_.groupBy("slice").cogroup(encoded.groupBy("slice")).applyInArrow(joined, schema)
