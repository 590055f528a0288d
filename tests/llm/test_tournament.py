import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from spoorless.llm import tournament


def brute(rows, count, rounds, width):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * Fraction(float(x))) for x in v]))
    centroids = [v for _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            if mine := [v for (_, v), k in zip(kept, at, strict=True) if k == c]:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = [nearest(v) for _, v in kept]
    found = [(i, c, far(v, centroids[c])) for (i, v), c in zip(kept, at, strict=True)]
    long = lambda n: n if n < 2**63 else None
    of = lambda c: long(sum(d for _, k, d in found if k == c))
    return sorted(((i, c, long(d), of(c), long(sum(x[2] for x in found)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def run(spark, rows, kind="double", **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, CLUSTER string").repartition(3)
    return sorted(map(tuple, tournament.cluster(df, **options).collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(6).round(1).tolist()) for k in range(150)]
    rows += [(200 + k, rows[k % 3][1]) for k in range(60)]  # copies, so ties of distance too
    rows += [(300, None), (301, [1.0] * 5), (302, [None] + [1.0] * 5), (303, [math.nan] * 6), (304, [math.inf] + [0.0] * 5), (305, []), (None, [0.5] * 6), (7, [0.25] * 6)]
    for count, rounds in ((5, 3), (16, 1), (1, 2)):
        assert run(spark, rows, count=count, rounds=rounds, width=6) == brute(rows, count, rounds, 6)


def test_numbers_of_any_size(spark):
    rows = [(k, [s * 10.0 ** (k * 7 % 300), -1e-300 * k, 0.1 * k]) for k, s in enumerate([1, -1] * 25)] + [(90, [1.7e308, -1.7e308, 3.0])]
    assert run(spark, rows, count=4, rounds=2, width=3) == brute(rows, 4, 2, 3)
    wide = [(k, [(2.0**25 - 1) * (-1) ** k, 2.0**20 * k, -(2.0**24)]) for k in range(20)]
    assert run(spark, wide, count=3, rounds=2, width=3) == brute(wide, 3, 2, 3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0] * 64)], [(1, [0.0] * 64)] * 3 + [(2, [-0.01] * 64)]])
def test_few_and_repeated_rows(spark, rows):
    assert run(spark, rows, "float") == brute(rows, 16, 3, 64)


def test_ties_go_to_the_smaller_number():
    bracket = tournament.Bracket([[0, 0], [2, 0], [0, 2], [0, 0]])
    assert bracket.play(np.array([[1, 1], [1, 0], [0, 0], [2, 2]])).tolist() == [0, 0, 0, 1]


def test_rounding_is_downwards():
    import pyarrow as pa

    assert tournament.whole(pa.array([[-0.001, 0.0157, 1.0]], pa.list_(pa.float64())), 3)[1].tolist() == [[-1, 1, 64]]
