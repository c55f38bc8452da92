"""What near copies are compared and stored for, beside the result."""

import random

import numpy as np

from tessera.llm import near_copies as N


def test_large_group_is_compared_in_proportion(spark, monkeypatch):
    """Copies of one text, each with some other words: alike to it, and by chance to each other."""
    pick, base = random.Random(5), [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for _ in range(240):
        text = base.copy()
        for at in pick.sample(range(400), 8):
            text[at] = f"n{pick.randrange(10**6)}"
        rows.append((len(rows), " ".join(text)))
    compared, columns, agreeing, stored = [], [], N._agreeing, N.stored

    def counted(pairs, reps):
        compared.append(pairs.count())
        return agreeing(pairs, reps)

    def noted(df, tag, *more, **named):
        columns.append((tag, df.columns))
        return stored(df, tag, *more, **named)

    monkeypatch.setattr(N, "_agreeing", counted)
    monkeypatch.setattr(N, "stored", noted)
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.class_id for r in got.collect()} == {0}
    assert sum(compared) <= 4 * len(rows)
    assert {tag for tag, names in columns if "text" in names} == {"texts"}


def test_packed_cells_come_back():
    rng = np.random.default_rng(4)
    cells = np.sort(rng.integers(0, 1 << 8 * N.CELL_BYTES, 900))
    rows, step, scale = (9 << 16) + rng.integers(0, 1 << 16, 900), rng.integers(0, 256, 900).astype(np.uint8), rng.integers(0, 256, 900).astype(np.uint8)
    back = N.unpacked(9, N.packed(cells, rows, step, scale))
    assert all((x == y).all() for x, y in zip(back, (cells, rows, step, scale), strict=True))
    hashes = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    assert (N.cells_of(N.packed_cells(hashes)) == (hashes >> np.uint64(64 - 8 * N.CELL_BYTES)).astype(np.int64)).all()


def test_similar_sets_are_kept_by_size_and_place():
    """Wherever two similar sets first meet, both are kept, among few others and among many."""
    rng, seen = np.random.default_rng(6), 0
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(400):
        every = np.unique(rng.integers(0, 1 << 63, rng.integers(2, 400), dtype=np.uint64))
        a, b = (np.sort(rng.permutation(every)[rng.integers(0, 1 + len(every) // 5) :]) for _ in "ab")
        if N.similarity(a, b) < N.SIMILARITY:
            continue
        seen += 1
        first = [N.prefix(x, none) for x in (a, b)]
        cell = next(h for h in first[0] if h in first[1])
        steps = np.array([int(np.flatnonzero(x == cell)[0]) * 256 // len(x) for x in first], np.uint8)
        scales = N.size_class(np.array([len(a), len(b)]))
        assert N.met(np.array([3, 5, 5, 8]), np.r_[0, steps, 0].astype(np.uint8), np.r_[9, scales, 9].astype(np.uint8)).tolist() == [False, True, True, False]
    assert seen > 100
    assert N.met(np.repeat(7, N.NEAR + 1), np.full(N.NEAR + 1, 255, np.uint8), np.arange(N.NEAR + 1, dtype=np.uint8) * 14).all()
