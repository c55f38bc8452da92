"""Token ids as binary: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

Every distinct piece of the corpus is given to the tokenizer once (`pieces`). Layout written by `write`, below one folder of
the shared store:
  codebook/  one row: `lengths`, one byte for each id, its code length (0: the id doesn't occur)
  blocks/    rows (part, seq, before, n, block): parts and blocks in order hold the documents in ascending id order; before
             counts the ids of the part's earlier blocks, n the block's
A block is bytes: header `<4sIIII` (magic, documents, ids, checkpoint stride, payload bytes), the documents' keys as
little-endian int64 with a byte each for null, their id counts as uint32, the bit offset of every stride-th id as uint32,
then the code bits, highest first, padded to whole bytes. Each block decodes alone, and within it every checkpoint starts
its own lane, so all lanes advance together in numpy.

Null texts count as empty and a null document id sorts first; equal ids are ordered by their text's hash, and repeated
rows are written each time. Columns other than id and text are not part of the file. An empty table gives no blocks.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from ..sources.scratch import fresh_path
from .common import give_back, map_columns, scratch, stored
from .pieces import Encode, encode_texts

MAX_LENGTH = 16
BLOCK_IDS = 1 << 18
STRIDE = 256
MAGIC = b"HTB1"
#: One-word pieces that the library gets in one text, and texts that it gets in one call: its results are large.
LINES, CALL = 200, 32


def library_encoder(path: str) -> Encode:
    """Distinct pieces -> (ids, starts, sizes) with the tokenizers library as it is, without adding special tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    batch = tok.encode_batch_fast
    (mark,) = tok.encode("\n", add_special_tokens=False).ids

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of one word go to the library many at a time, a line each; a line end is always a token of its own between them."""
        is_plain = np.array([c.isprintable() and c.rfind(" ") <= 0 and c != " " for c in new], bool)
        plain, rest = np.flatnonzero(is_plain).tolist(), np.flatnonzero(~is_plain).tolist()
        lines = ["\n".join([new[i] for i in plain[k : k + LINES]]) + "\n" for k in range(0, len(plain), LINES)]
        parts, sizes_of = [np.zeros(0, np.int32)], []
        texts = lines + [new[i] for i in rest]
        for k in range(0, len(texts), CALL):
            found = [e.ids for e in batch(texts[k : k + CALL], add_special_tokens=False)]
            sizes_of += map(len, found)
            parts.append(np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found))))
        flat, n_lines = np.concatenate(parts), sum(sizes_of[: len(lines)])
        marks = np.flatnonzero(flat[:n_lines] == mark)
        if len(marks) != len(plain):
            raise ValueError(f"{len(plain)} pieces of one word, but {len(marks)} line ends after them")
        starts, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        starts[is_plain] = np.concatenate([[0], marks[:-1] + 1]) if len(marks) else 0
        sizes[is_plain] = marks - starts[is_plain]
        sizes[~is_plain] = sizes_of[len(lines) :]
        starts[~is_plain] = n_lines + np.cumsum(sizes[~is_plain]) - sizes[~is_plain]
        return flat, starts, sizes

    return encode


def tokenize(docs: DataFrame, path: str, end_id: int, vocab: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, h, n, data): the text's hash, and n ids as little-endian integers of two bytes, or four for a large vocab."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h"), F.col(f"`{text_col}`").alias("text"))
    dtype = np.dtype(id_type(vocab))

    def pack(ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        ids, cut = np.insert(ids, offsets[1:], end_id).astype(dtype), offsets + np.arange(len(offsets))
        data = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((dtype.itemsize * cut).astype(np.int32)), pa.py_buffer(ids)])
        return [pa.array(np.diff(cut), pa.int64()), data]

    outputs = [StructField("n", LongType(), False), StructField("data", BinaryType(), False)]
    return encode_texts(rows, "text", lambda: library_encoder(path), outputs, pack, keep_text=False)


def id_type(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids have no codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight, m = counts[used].astype(np.float64), len(used)
    # each level's list is the leaves merged with the pairs of the level below; only which entries are leaves is kept
    levels, below = [], weight
    leaf = np.ones(m, bool)
    levels.append(leaf)
    for _ in range(limit - 1):
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < m)
        below = both[order]
    take = 2 * m - 2
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id as an integer: ascending by (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id and the code length for every value of the next MAX_LENGTH bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (MAX_LENGTH - lengths[order].astype(np.int64))
    ids, sizes = np.repeat(order, spans).astype(np.uint32), np.repeat(lengths[order], spans)
    pad = (1 << MAX_LENGTH) - len(ids)
    return np.pad(ids, (0, pad)), np.pad(sizes, (0, pad), constant_values=1)


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(code bits, bit offset of every STRIDE-th id)."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ends) else 0
    word, shift = at >> 5, 64 - (at & 31) - n
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    size = (total >> 5) + 2
    high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=size)
    low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
    bits = (high[:size] + low[:size]).astype(np.uint64).astype(">u4").tobytes()
    return bits[: (total + 7) // 8], at[::STRIDE].astype("<u4")


def make_block(docs: list[int | None], counts: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    payload, marks = pack(ids, codes, lengths)
    keys = np.array([0 if d is None else d for d in docs], "<i8").tobytes() + bytes(d is None for d in docs)
    return struct.pack("<4sIIII", MAGIC, len(docs), len(ids), STRIDE, len(payload)) + keys + counts.astype("<u4").tobytes() + marks.tobytes() + payload


def read_block(block: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(documents, their id counts, all ids)."""
    magic, n_docs, n_ids, stride, n_bytes = struct.unpack_from("<4sIIII", block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = 20
    keys = np.frombuffer(block, "<i8", n_docs, at).tolist()
    nulls = block[at + 8 * n_docs : at + 9 * n_docs]
    at += 9 * n_docs
    counts = np.frombuffer(block, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    lanes = -(-n_ids // stride)
    pos = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
    at += 4 * lanes
    data = np.frombuffer(block[at : at + n_bytes] + b"\0\0\0\0", np.uint8)
    triple = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    out = np.zeros((stride, lanes), np.uint32)
    by_id, by_size = table
    left = n_ids - (lanes - 1) * stride  # ids of the last lane
    for k in range(min(stride, n_ids)):
        live = lanes if k < left else lanes - 1
        p = pos[:live]
        window = triple[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF
        out[k, :live] = by_id[window]
        pos[:live] = p + by_size[window]
    return [None if z else k for k, z in zip(keys, nulls, strict=True)], counts, out.T.reshape(-1)[:n_ids] if n_ids else out.reshape(-1)[:0]


def write(docs: DataFrame, path: str, end_id: int, vocab: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> str:
    """Write the ids of docs, each document's followed by end_id, and return the folder. vocab bounds ids and code table.

    The driver gets one row for each id of the vocabulary.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    with scratch(spark):
        _write(docs, path, end_id, vocab, folder, id_col, text_col, block_ids)
    return folder


def _write(docs: DataFrame, path: str, end_id: int, vocab: int, folder: str, id_col: str, text_col: str, block_ids: int) -> None:
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, path, end_id, vocab, id_col, text_col), "tokens")
    dtype = id_type(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype), minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(vocab, np.int64)
    for r in tokens.select("data").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast((canonical_codes(lengths), lengths))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = shared.value
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(h[2] for h in held), dtype)
            block = make_block([h[0] for h in held], np.array([h[1] for h in held]), ids, codes, lengths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([block])], names=["part", "seq", "before", "n", "block"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc", "n", "data")), strict=True):
                if held and size + row[1] > block_ids:
                    yield flush()
                    held, seq, before, size = [], seq + 1, before + size, 0
                held.append(row)
                size += row[1]
        if held:
            yield flush()
        held.clear()
        give_back()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, "doc").sortWithinPartitions(F.col("doc").asc_nulls_first(), "h")
    ordered.mapInArrow(encode, _BLOCKS).write.option("compression", "none").mode("overwrite").parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.mode("overwrite").parquet(f"{folder}/codebook")
    shared.unpersist()


_BLOCKS = "part int, seq long, before long, n long, block binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, start, n_tokens, ids): what the files hold, start being the number of ids before the document's.

    The driver gets one row for each part, of which `write` makes as many as the session has shuffle partitions.
    """
    lengths = np.frombuffer(bytes(spark.read.schema("lengths binary").parquet(f"{folder}/codebook").first()[0]), np.uint8)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    first, so_far = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        first[r["part"]], so_far = so_far, so_far + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for b in batches:
            for part, before, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs, counts, ids = read_block(block, table)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first[part] + before + ends - counts), pa.array(counts), lists], names=["doc", "start", "n_tokens", "ids"])
            give_back()

    return blocks.select("part", "before", "block").mapInArrow(run, "doc long, start long, n_tokens long, ids array<int>")


def with_crc32(df: DataFrame, ids_col: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """df without the ids, with the unsigned crc32 of them as little-endian unsigned 32-bit integers."""

    def make():
        def run(col: pa.ListArray):
            flat = col.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            cut = 4 * np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False))])
            return [pa.array([zlib.crc32(flat[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.int64())]

        return run

    return map_columns(df, [ids_col], [StructField(out, LongType(), False)], make, (ids_col,))
