"""Vector codes against brute force in integers of any size."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formline.llm import codes


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 200), st.integers(1, 5), st.sampled_from([2, 30, 1 << 24, 1 << 40, 1 << 70]), st.integers(0, 2**32))
def test_nearest_entries_equal_brute_force(n, width, reach, seed):
    rng = np.random.default_rng(seed)
    draw = lambda rows: [[int(x * reach) for x in r] for r in rng.uniform(-1, 1, (rows, width))]
    points, q = draw(n), draw(40)
    q += points[:10]
    at, best, _ = codes.nearest(codes.Gnat(codes._integers(points)), codes._integers(q))
    for i, x in enumerate(q):
        d, entry = min((sum((a - b) ** 2 for a, b in zip(x, p)), k) for k, p in enumerate(points))
        assert (int(best[i]), at[i]) == (d, entry)


def test_subtrees_are_ruled_out():
    rng = np.random.default_rng(5)
    points = rng.integers(-1000, 1000, (256, 2))
    q = rng.integers(-1000, 1000, (500, 2))
    _, _, met = codes.nearest(codes.Gnat(points), q)
    assert met < 0.5 * 256 * 500


def brute(rows, parts=4, entries=256, rounds=4):
    """{place of a kept row: (id, code, error, label_error, digest)} of rows (id, vector, label)."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    whole = [[math.floor(1024 * x) if math.isfinite(1024 * x) else int(x) * 1024 for x in [*v, *[0.0] * (width - len(v))]] for _, v, _ in kept]
    d = width // parts
    cut = [[tuple(v[p * d : (p + 1) * d]) for p in range(parts)] for v in whole]
    ids = sorted({i for i, _, _ in kept}, key=lambda i: (i is None, i or 0))[:entries]
    first = [min((v, k) for k, (j, v, _) in enumerate(kept) if j == i)[1] for i in ids]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got) if g[p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(x) // len(mine) for x in zip(*mine))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got, by_label = assign(), {}
    cap = lambda x: min(x, codes.LONG)
    for (_, _, l), g in zip(kept, got):
        by_label[l] = by_label.get(l, 0) + cap(sum(x for x, _ in g))
    return [(i, "".join(f"{k:02x}" for _, k in g), cap(sum(x for x, _ in g)), cap(by_label[l]), digest) for (i, _, l), g in zip(kept, got)]


def table_of(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], f"vec_id long, embedding {kind}, label int, code string")


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.1, 8)], int(i) % 5 if i % 7 else None) for i in rng.permutation(400)]
    rows += [(400, None, 1), (401, [0.1, None, *[0.0] * 6], 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, 2)]
    got = codes.compress(table_of(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e17, 1e300])
def test_odd_tables(spark, scale):
    rows = [(1, [0.25 * scale, -0.5 * scale, 1.0, 2.0, 3.5], 1), (1, [0.25 * scale, -0.5 * scale, 1.0, 2.0, 3.5], 1), (1, [0.5], None), (None, [], None), (None, [-scale] * 5, 2), (2, [1.0, 1.0, 1.0, 1.0, 1.0], 2), (7, [], 1)]
    got = codes.compress(table_of(spark, rows, "array<double>"), entries=3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows, entries=3), key=repr)
    assert codes.compress(table_of(spark, rows, "array<double>").limit(0)).count() == 0
    assert codes.compress(table_of(spark, [(1, None, 1)], "array<double>")).count() == 0


def test_equal_entries_and_many_entries(spark):
    rows = [(i, [float(i % 3)] * 4, i % 2) for i in range(600)]
    got = codes.compress(table_of(spark, rows), entries=256)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_one_label_for_all(spark):
    rows = [(i, [float(i)] * 4, i) for i in range(10)]
    got = codes.compress(table_of(spark, rows), entries=2, label_col=None).collect()
    assert {r.label_error for r in got} == {sum(r.error for r in got)}
