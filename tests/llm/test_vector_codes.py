"""Codes of vectors against a plain computation, and the tree against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from lectern.llm import vector_codes


@pytest.mark.parametrize("spread", [1, 3, 1000, 10**6])
def test_tree_finds_what_all_distances_say(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (256, 4))
    points[100:130] = points[7]
    queries = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (3000, 4)), points])
    d = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    index, best = vector_codes.Gnat.build(points).nearest(queries)
    assert (best == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()


def test_tree_leaves_out_most_entries():
    rng = np.random.default_rng(5)
    centres = rng.integers(-(10**4), 10**4, (16, 8))
    points = (centres[:, None] + rng.integers(-20, 20, (16, 16, 8))).reshape(-1, 8)
    tree, asked = vector_codes.Gnat.build(points), 0
    whole = vector_codes.squares

    def counted(q, p):
        nonlocal asked
        asked += len(q) * len(p)
        return whole(q, p)

    vector_codes.squares = counted
    try:
        tree.nearest(np.repeat(points, 4, axis=0) + 3)
    finally:
        vector_codes.squares = whole
    assert asked < 0.4 * 1024 * len(points)


def test_distances_are_exact_in_both_ways():
    rng = np.random.default_rng(6)
    for size in (1000, 1 << 26):
        q, p = rng.integers(-size, size, (50, 16)), rng.integers(-size, size, (30, 16))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in p] for x in q]
        assert vector_codes.squares(q, p).tolist() == want


def plain(rows, parts, entries, rounds):
    usable = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    n = len(usable[0][1])
    cut = lambda v, k: v[k * n // parts : (k + 1) * n // parts]
    books = [[list(cut(v, k)) for _, v, _ in usable[:entries]] for k in range(parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k, book in enumerate(books):
            groups = {}
            for _, v, _ in usable:
                groups.setdefault(near(cut(v, k), book)[1], []).append(cut(v, k))
            for j, g in groups.items():
                book[j] = [sum(c) // len(g) for c in zip(*g)]
    out, totals = [], {}
    for i, v, lab in usable:
        found = [near(cut(v, k), books[k]) for k in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab))
        totals[lab] = totals.get(lab, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, totals[lab], sha) for i, c, e, lab in out)


def vectors():
    random.seed(2)
    draw = lambda n=10: [random.choice([-1, 1]) * random.random() for _ in range(n)]
    rows = [(k, draw(), k % 3 if k % 5 else None) for k in range(90)]
    rows += [(200 + k, rows[4][1], 1) for k in range(60)]  # one vector many times
    rows += [(5, draw(), 7), (5, rows[5][1], 7), (None, draw(), None), (300, draw(4), 1), (301, [], 1)]
    rows += [(302, None, 1), (303, draw(9) + [None], 1), (304, draw(9) + [float("nan")], 1), (305, draw(9) + [float("-inf")], 1)]
    return rows


@pytest.mark.parametrize("parts, entries, rounds", [(4, 256, 4), (4, 20, 4), (3, 1, 2)])
def test_codes_equal_the_plain_computation(spark, parts, entries, rounds):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, n int")
    got = vector_codes.code_rows(df, parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain(rows, parts, entries, rounds)


def test_nothing_to_code(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [float("nan")], None)], "vec_id long, embedding array<float>, label int")
    for empty in (df, df.limit(0)):
        got = vector_codes.code_rows(empty)
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    huge = spark.createDataFrame([(1, [1e30, 1.0], 1), (2, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in vector_codes.code_rows(huge).collect()] == [2]
