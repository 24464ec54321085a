import math
import random

import numpy as np
import pytest

from tracewright.llm.vector_codes import Round, _packed, _unpacked, _up, compress_vectors, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x string"


def brute(rows, entries, parts=4, rounds=4):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(1024 * float(np.float32(c))) for c in v] for _, v, _ in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda: np.array([[((b - v[p]) ** 2).sum(1).argmin() for p, b in enumerate(books)] for v in x])
    for _ in range(rounds):
        code = near()
        for p in range(parts):
            for e in set(code[:, p].tolist()):
                own = x[code[:, p] == e, p]
                books[p, e] = own.sum(0) // len(own)
    code = near()
    error = [int(sum(((books[p, c] - v[p]) ** 2).sum() for p, c in enumerate(own))) for v, own in zip(x, code)]
    label = {}
    for (_, _, k), e in zip(kept, error):
        label[k] = label.get(k, 0) + e
    return sorted(((i, bytes(c.tolist()).hex(), e, label[k]) for (i, _, k), c, e in zip(kept, code, error)), key=str), books


def run(spark, rows, entries, slices=3):
    df = spark.createDataFrame([(i, v, k, "c", None) for i, v, k in rows], SCHEMA).repartition(slices)
    codes, books = compress_vectors(df, entries=entries)
    got = with_label_error(codes).collect()
    return sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in got), key=str), books


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_same_as_brute_force(spark, kind):
    rng = random.Random(kind)
    n, width = {"spread": (700, 12), "ties": (500, 8), "few": (9, 4)}[kind]
    value = {"spread": lambda: rng.gauss(0, 0.3), "ties": lambda: rng.choice([-1, 0, 1]) / 512 + rng.choice([0, 1e-5]), "few": lambda: rng.choice([-0.5, 0.25])}[kind]
    rows = [(i * 3, [value() for _ in range(width)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(1, None, 0), (2, [None] * width, 0), (4, [float("nan")] * width, 1), (5, [float("inf")] + [0.0] * (width - 1), None)]
    rows += [(None, rows[0][1], 2), (None, rows[1][1], None), (rows[2][0], rows[2][1], 0), (rows[2][0], rows[3][1], 0), (7, [-0.0] * width, 1)]
    rng.shuffle(rows)
    got, books = run(spark, rows, 64)
    want, expected = brute(rows, 64)
    assert (books == expected).all()
    assert got == want


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    codes, books = compress_vectors(df)
    assert with_label_error(codes).collect() == [] and books.size == 0
    with pytest.raises(ValueError):
        compress_vectors(spark.createDataFrame([(1, [0.0] * 8, 0, "", ""), (2, [0.0] * 12, 0, "", "")], SCHEMA))
    with pytest.raises(ValueError):
        compress_vectors(spark.createDataFrame([(1, [1e30] * 8, 0, "", "")], SCHEMA))


def test_bounds_are_safe():
    rng = np.random.default_rng(1)
    x = np.r_[0, rng.uniform(0, 1e6, 5000), rng.integers(0, 1000, 500), 2.0**31]
    assert (_unpacked(_packed(x)) <= x).all() and (_unpacked(_packed(x)) >= x * 0.99).all()
    assert (_unpacked(_packed(_unpacked(_packed(x)))) == _unpacked(_packed(x))).all()
    assert (_up(x) >= x).all()


def test_bounds_prune():
    """From the second round on, most entries of clustered vectors are ruled out without a distance."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (64, 8))
    x = (centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int64)
    own, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, 64))
    first = Round(centres[None].astype(np.int64), None)
    first.assign(0, x, own, upper, lower)
    assert (own == ((x[:, None] - centres) ** 2).sum(2).argmin(1)).all()
    moved = centres + rng.integers(-3, 4, centres.shape)
    second, made = Round(moved[None].astype(np.int64), first.now), []
    second._pairs = lambda a, b: made.append(len(a)) or ((a - b) ** 2).sum(1)
    second.assign(0, x, own, upper, lower)
    assert (own == ((x[:, None] - moved) ** 2).sum(2).argmin(1)).all()
    assert sum(made) < 3000 * 64 // 20
