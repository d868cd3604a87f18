"""Vector codes against exhaustive search in whole numbers; the tree on ties, repeats and large numbers; odd tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from ripplemark.llm import vector_codes as V


def plain_nearest(points, queries):
    return [min((sum((int(a) - int(b)) ** 2 for a, b in zip(q, p)), i) for i, p in enumerate(points)) for q in queries]


@pytest.mark.parametrize("seed", range(8))
def test_tree_equals_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    d, spread = [(1, 3), (2, 4), (3, 50), (16, 300), (4, 1), (2, 1 << 26), (16, 1 << 26), (5, 10)][seed]
    points = rng.integers(-spread, spread + 1, (256, d))
    points[200:220] = points[10]  # repeats
    queries = np.concatenate([rng.integers(-spread, spread + 1, (300, d)), points[:60], (points[:30] + points[30:60]) // 2])
    best, least = V.Gnat(points).nearest(queries)
    assert list(zip(least.tolist(), best.tolist())) == plain_nearest(points, queries)


def test_subtrees_are_passed_over(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(-100_000, 100_000, (16, 4))
    points = np.concatenate([c + rng.integers(-20, 20, (16, 4)) for c in centres])
    tree, made, squared = V.Gnat(points), [0], V.Gnat._squared
    monkeypatch.setattr(V.Gnat, "_squared", lambda self, q, ids, largest: made.__setitem__(0, made[0] + len(q) * len(ids)) or squared(self, q, ids, largest))
    queries = centres[rng.integers(0, 16, 500)] + rng.integers(-20, 20, (500, 4))
    best, least = tree.nearest(queries)
    assert list(zip(least.tolist(), best.tolist())) == plain_nearest(points, queries) and made[0] < 500 * 256 / 4


def test_small_and_equal_trees():
    for points in (np.zeros((300, 3), int), np.zeros((1, 3), int), np.zeros((5, 0), int), np.arange(17)[:, None]):
        queries = np.zeros((4, points.shape[1]), int)
        best, least = V.Gnat(points).nearest(queries)
        assert best.tolist() == [0] * 4 and least.tolist() == [0] * 4


def plain(rows, entries=256, rounds=4, parts=4):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    whole = [[int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(np.float32(x)) for x in kept[k][1]]))[:entries]
    d = width // parts
    books = [[whole[k][p * d : (p + 1) * d] for k in order] for p in range(parts)]

    def assigned():
        return [plain_nearest(books[p], [w[p * d : (p + 1) * d] for w in whole]) for p in range(parts)]

    for _ in range(rounds):
        for p, found in enumerate(assigned()):
            held = defaultdict(list)
            for w, (_, i) in zip(whole, found):
                held[i].append(w[p * d : (p + 1) * d])
            for i, vs in held.items():
                books[p][i] = [sum(x) // len(vs) for x in zip(*vs)]
    last = assigned()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(last[p][k][0] for p in range(parts)) for k in range(len(kept))]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return sorted(((i, "".join(f"{last[p][k][1]:02x}" for p in range(parts)), errors[k], by_label[label], sha) for k, (i, _, label) in enumerate(kept)), key=str)


def held(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted((tuple(r) for r in V.query(df).collect()), key=str)


def test_codes_equal_a_plain_version(spark):
    rng = random.Random(1)
    vector = lambda n=8: [rng.choice([rng.uniform(-1, 1), rng.choice([0.0, 0.5, -0.5, 1 / 1024])]) for _ in range(n)]
    rows = [(i, vector(), rng.choice([1, 2, None])) for i in range(330)]
    rows += [(7, vector(), 1), (7, rows[7][1], 1), (None, vector(), None), (400, None, 1), (401, [], 2), (402, [0.1, None] * 4, 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] * 8, 1)]
    rows += [(-5, rows[3][1], 3), (-6, rows[3][1], 3), (500, vector(3), 2), (501, [1e30, -1e30] * 4, 9)]
    got = held(spark, [r for r in rows if r[0] != 501])
    assert got == plain([r for r in rows if r[0] != 501])
    assert len(held(spark, rows)) == len(got) + 1  # beyond what a long holds values are held back


def test_few_vectors_and_none(spark):
    assert held(spark, []) == held(spark, [(1, None, 1)]) == []
    assert held(spark, [(1, [0.5] * 4, None), (2, [0.25] * 4, None)]) == plain([(1, [0.5] * 4, None), (2, [0.25] * 4, None)])
    assert held(spark, [(1, [], 1)]) == plain([(1, [], 1)]) and held(spark, [(3, [1.0], 1)] * 5) == plain([(3, [1.0], 1)] * 5)


def test_encode_keeps_any_columns(spark):
    df = spark.createDataFrame([(1, [0.1] * 4, 5, "x"), (2, None, 6, "y"), (3, [0.9] * 4, 7, "z")], "vec_id long, embedding array<double>, codes int, row string")
    codec = V.train(df, entries=2, rounds=1)
    got = {r.row.vec_id: (r.row.codes, r.row.row, r.codes, r.error) for r in V.encode(df, codec).collect()}
    assert got == {1: (5, "x", [0] * 4, 0), 3: (7, "z", [1] * 4, 0)}
