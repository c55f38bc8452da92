"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus is cut into pieces and each distinct piece is encoded once (`pieces`). The distinct pre-tokens of a bucket of
pieces form one sequence of byte tokens. An inverted index holds, for each pair of tokens that makes a token, the positions
where the pair stands. Merges are replayed in rank order; a merge touches only its two neighbours, whose new pairs are
entered in the index. A pair of a lower rank than the current one is replayed before the rest of its word goes on, and a
pre-token that is itself a token is taken whole, both as the tiktoken library does.

Null texts count as empty: no ids, and decoding gives no bytes. Extra columns stay, except those with an output's name,
which are replaced. Repeated rows stay repeated, an empty table gives an empty table, and texts may be of any length.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from .common import map_columns
from .pieces import Encode, encode_texts, gather

#: Distinct pre-tokens replayed together; bounds a task's memory.
REPLAY_WORDS = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes): where each word's ids stand."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        rest = np.flatnonzero(whole < 0)
        parts, sizes, starts = [whole], np.ones(len(words), np.int64), np.arange(len(words))
        at = len(words)
        for k in range(0, len(rest), REPLAY_WORDS):
            part = rest[k : k + REPLAY_WORDS]
            flat, n = self._replay([words[i] for i in part.tolist()])
            sizes[part], starts[part] = n, at + np.cumsum(n) - n
            parts.append(flat)
            at += len(flat)
        return np.concatenate(parts), starts, sizes

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that pairs of ids make, or -1; an id of -1 makes none."""
        keys = left << 20 | right
        if len(keys) > 48:
            keys, back = np.unique(keys, return_inverse=True)
        else:
            back = None
        known, out = self.pairs, []
        for key in keys.tolist():
            r = known.get(key)
            if r is None:
                if len(known) > 500_000:
                    known.clear()
                r = known[key] = -1 if key < 0 else self.ranks.get(self.token[key >> 20] + self.token[key & 0xFFFFF], -1)
            out.append(r)
        found = np.array(out, np.int64)
        return found if back is None else found[back]

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words, how many each has)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        # place n stands beyond either end of a word
        ids = np.append(self.single[np.frombuffer(b"".join(words), np.uint8)], -1)
        nxt, prv, word = np.arange(1, n + 2), np.arange(-1, n), np.repeat(np.arange(len(words)), sizes)
        full = sizes > 0
        nxt[ends[full] - 1] = n
        prv[(ends - sizes)[full]] = n
        # the index: places by the pair that begins there, and the pairs of each rank
        pair = np.full(n + 1, -1, np.int64)
        both = np.flatnonzero(nxt[:n] < n)
        distinct, inverse = np.unique(ids[both] << 20 | ids[both + 1], return_inverse=True)
        pair[both] = self._ranks(distinct >> 20, distinct & 0xFFFFF)[inverse] if len(both) else -1
        index: dict[int, list[np.ndarray]] = {}
        of_rank: dict[int, list[int]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(places):
                return
            pairs = ids[places] << 20 | ids[nxt[places]]
            order = np.argsort(pairs, kind="stable")
            places, ranks, pairs = places[order], ranks[order], pairs[order]
            cut = np.append(0, np.flatnonzero(pairs[1:] != pairs[:-1]) + 1)
            for key, r, p in zip(pairs[cut].tolist(), ranks[cut].tolist(), np.split(places, cut[1:]), strict=True):
                if key in index:
                    index[key].append(p)
                    continue
                index[key] = [p]
                if r in of_rank:
                    of_rank[r].append(key)
                else:
                    of_rank[r] = [key]
                    heappush(heap, r)

        enter(both, pair[both])
        while heap:
            rank = heappop(heap)
            lists = [p for key in of_rank.pop(rank) for p in index.pop(key)]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                chained = nxt[at[:-1]] == at[1:]
                if chained.any():  # of overlapping pairs every other one, from the left
                    i = np.arange(len(at))
                    at = at[(i - np.maximum.accumulate(np.where(np.append(True, ~chained), i, 0))) % 2 == 0]
                twice = word[at[1:]] == word[at[:-1]]
                if twice.any():
                    some = at[np.append(twice, False) | np.append(False, twice)]
                    new = self._ranks(np.concatenate([np.full(len(some), rank), ids[prv[some]]]), np.concatenate([ids[nxt[nxt[some]]], np.full(len(some), rank)]))
                    if ((new >= 0) & (new < rank)).any():
                        later = at[1:][twice]  # a lower rank may come up in these words first
                        at = at[np.append(True, ~twice)]
                        enter(later, np.full(len(later), rank))
            gone = nxt[at]
            after = nxt[gone]
            ids[at], ids[gone], pair[gone] = rank, -1, -1
            nxt[at], prv[after] = after, at
            ids[n], pair[n] = -1, -1
            before = prv[at]
            same = np.full(len(at), rank)
            new = self._ranks(np.concatenate([same, ids[before]]), np.concatenate([ids[after], same]))
            pair[at], pair[before] = new[: len(at)], new[len(at) :]
            pair[n] = -1
            enter(np.concatenate([at, before]), new)
        live = ids[:n] >= 0
        counts = np.append(0, np.cumsum(live))[np.append(0, ends)]
        return ids[:n][live], np.diff(counts)


def encoder(path: str, pattern: str) -> Encode:
    """Distinct pieces -> (ids, starts, sizes), by the distinct pre-tokens in them."""
    import regex

    replay, split = MergeReplay(load_ranks(path)), regex.compile(pattern).findall

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at: defaultdict[str, int] = defaultdict()
        at.default_factory = at.__len__
        rows, counts = array("i"), array("i")
        for piece in pieces:
            found = split(piece)
            counts.append(len(found))
            rows.extend(map(at.__getitem__, found))
        at.default_factory = None  # else the table and its words stay until the next full collection
        if not rows:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        flat, ends = gather(*replay.encode([w.encode() for w in at]), np.frombuffer(rows, np.int32))
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int32))])]
        return flat.astype(np.int32), cut[:-1], np.diff(cut)

    return encode


def id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs with the ids of every match of pattern in its text, array<int>. path: a tiktoken rank file that executors can read."""
    outputs = [StructField(out, ArrayType(IntegerType(), False), False)]
    return encode_texts(docs, text_col, lambda: encoder(path, pattern), outputs, lambda ids, offsets: [id_lists(ids, offsets)], keep_text)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for, by one gather over a table of all tokens' bytes. Null ids give no bytes."""

    def make():
        token = {r: t for t, r in load_ranks(path).items()}
        sizes = np.array([len(token.get(i, b"")) for i in range(max(token) + 1)], np.int64)
        flat, starts = np.frombuffer(b"".join(token.get(i, b"") for i in range(len(sizes))), np.uint8), np.cumsum(sizes) - sizes
        del token

        def run(col: pa.ListArray):
            ids = col.flatten().to_numpy(zero_copy_only=False)
            counts = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            data, ends = gather(flat, starts, sizes, ids)
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            return [pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])]

        return run

    return map_columns(df, [ids_col], [StructField(out, BinaryType(), False)], make)
