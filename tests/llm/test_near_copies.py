"""Near copies against brute force over all pairs."""

import random

import pytest

from tessera.llm import near_copies as N


def brute(rows):
    sets = {i: set(N.shingle_hashes((t or "").encode().lower().split()).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("limit", [64, 4])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(N, "CELL_LIMIT", limit)
    monkeypatch.setattr(N, "PIVOTS", 2)
    pick, rows = random.Random(3), [(0, ""), (1, None), (2, " \t"), (3, "one two"), (4, "One  TWO"), (5, "one two three")]
    for _ in range(6):
        base = [f"w{pick.randrange(500)}" for _ in range(pick.choice([30, 120, 400]))]
        for _ in range(12):
            text = base.copy()
            for at in range(pick.randrange(0, 1 + len(text) // 25)):
                text[pick.randrange(len(text))] = f"n{pick.randrange(9)}"
            rows.append((len(rows), " ".join(text)))
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: r.class_id for r in got.collect()} == brute(rows)


def test_kept_rows(spark):
    rows = [(None, None, 1), (None, None, 1), (7, "a b c", 1), (7, "a b c", 1), (8, "A b c", 2), (None, "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v int")
    assert sorted(map(str, N.one_of_each(docs).collect())) == sorted(map(str, docs.dropDuplicates().where("not doc_id <=> 8").collect()))
    assert N.one_of_each(docs.limit(0)).collect() == []


def test_link_between_members_that_matched_different_pivots(spark, monkeypatch):
    """Two groups that only one pair links, with every cell of that pair crowded by both groups."""
    monkeypatch.setattr(N, "CELL_LIMIT", 2)
    monkeypatch.setattr(N, "PIVOTS", 1)
    monkeypatch.setattr(N, "embedding", lambda c: c * 0)
    core, texts = [f"c{k}" for k in range(204)], []
    for side in "xy":
        tail = [f"{side}{k}" for k in range(48)]
        texts += [core + tail[:24]] + [core + tail + [f"{side}own{k}"] for k in range(60)]
        texts += [core[-4:] + tail + [f"{side}other{k}n{i}" for i in range(100)] for k in range(80)]
    rows = list(enumerate(map(" ".join, texts)))
    want = brute(rows)
    assert sorted(want.values()).count(0) == 122 and len(set(want.values())) == 161
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: r.class_id for r in got.collect()} == want


def test_prefixes_of_similar_sets_meet_in_any_order():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        every = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64))
        counts = (every[: len(every) // 2], rng.integers(2, 9, len(every) // 2))
        a, b = (np.sort(rng.permutation(every)[rng.integers(0, 1 + len(every) // 8) :]) for _ in "ab")
        if N.similarity(a, b) >= N.SIMILARITY:
            assert set(N.prefix(a, counts).tolist()) & set(N.prefix(b, counts).tolist())


def test_parity_never_rules_out_similar_sets():
    import numpy as np

    rng, ruled_out = np.random.default_rng(2), 0
    for _ in range(400):
        every = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64))
        a, b = (np.sort(rng.permutation(every)[rng.integers(0, 1 + len(every) // 4) :]) for _ in "ab")
        difference = len(np.setxor1d(a, b))
        bound = N.least_difference(N.parity(a), N.parity(b))
        assert bound == N.least_difference(N.parity(b), N.parity(a)) <= difference
        assert (N.similarity(a, b) >= N.SIMILARITY) == (difference <= N.most_difference(len(a) + len(b)))
        ruled_out += difference > 1.3 * N.most_difference(len(a) + len(b)) and bound > N.most_difference(len(a) + len(b))
    assert ruled_out > 60
