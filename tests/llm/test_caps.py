import numpy as np
import pytest

from spoorless.llm import caps


def brute(rows, cosine=0.98):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.asarray(v, np.float64)
            good[k] = a / np.abs(a).max() / np.sqrt(((a / np.abs(a).max()) ** 2).sum())
    links = {k: [j for j in good if j != k and rows[j][2] == rows[k][2] and len(good[j]) == len(good[k]) and good[j] @ good[k] >= cosine] for k in good}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((i, len(links.get(k, [])), low, i == low))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, links string")
    return sorted(map(tuple, caps.near_vectors(df, **options).collect()), key=str if any(r[0] is None for r in rows) else None)


@pytest.mark.parametrize("piece", [1024, 7])
def test_against_brute_force(spark, piece):
    rng = np.random.default_rng(5)
    rows, centres = [], rng.standard_normal((12, 32))
    for k in range(260):
        c = centres[rng.integers(12)]
        rows.append((k, (c + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.16, 1.0])).astype(np.float32).tolist(), int(rng.integers(3)) or None))
    rows += [(300 + k, rows[0][1], 1) for k in range(40)]  # copies
    rows += [(400, None, 1), (401, [0.0] * 32, 1), (402, [float("nan")] * 32, 1), (403, [None] + [1.0] * 31, 1), (404, [], 1), (405, [1.0], 1), (406, [2.0], 1)]
    assert run(spark, rows, piece=piece) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (0, [1.0, 1e-3], 1)]) == [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False)]


def test_list_decoding_finds_every_exceeding_filter():
    rng = np.random.default_rng(6)
    book = caps.code_book(20, 3, 6)
    v = rng.standard_normal((15, 20))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cuts = np.cumsum([b.shape[1] for b in book])[:-1]
    for x, got in zip(v, caps.list_decode(v, book, 1.5, 1, 10_000)):
        parts = [p @ b.T for p, b in zip(np.split(x, cuts), book)]
        all_ = (parts[0][:, None, None] + parts[1][None, :, None] + parts[2][None, None, :]).ravel()
        spread = np.sqrt(sum((p**2).sum() / b.shape[1] for p, b in zip(np.split(x, cuts), book)))
        assert got.tolist() == np.flatnonzero(all_ >= min(1.5 * spread, all_.max() - 1e-9)).tolist()


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.001], 1)]
    assert run(spark, rows) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)] == brute(rows)
    assert sorted(run(spark, [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]), key=str) == sorted([(None, 1, 3, False), (3, 1, 3, True), (None, 0, None, True)], key=str)


def pairs(kind, dimensions, count, rng):
    """Unit vectors and partners at a cosine of just 0.98."""
    v = rng.standard_normal((count, dimensions))
    if kind == "concentrated":
        v[:, 5:] *= 1e-3
    elif kind == "anisotropic":
        v *= np.geomspace(1, 1e-2, dimensions)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    e = rng.standard_normal((count, dimensions)) * (np.abs(v).mean(0) if kind != "plain" else 1)
    e -= (e * v).sum(1, keepdims=True) * v
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return v, 0.98 * v + (1 - 0.98**2) ** 0.5 * e


@pytest.mark.parametrize("kind,dimensions", [("plain", 2), ("plain", 3), ("plain", 4), ("plain", 8), ("plain", 64), ("concentrated", 64), ("anisotropic", 64), ("plain", 768)])
@pytest.mark.parametrize("codes", [16, 32])
def test_pairs_at_the_threshold_share_a_filter(kind, dimensions, codes):
    v, w = pairs(kind, dimensions, 200, np.random.default_rng(dimensions))
    turned, book = caps.rotation(dimensions), caps.code_book(max(dimensions, caps.WIDE), codes=codes)
    assert np.allclose((v @ turned * (w @ turned)).sum(1), 0.98)
    a, b = (caps.list_decode(x @ turned, book) for x in (v, w))
    assert max(map(len, a)) <= caps.MOST and min(map(len, a)) >= caps.LEAST
    assert np.mean([bool(np.intersect1d(x, y).size) for x, y in zip(a, b, strict=True)]) >= 0.95


@pytest.mark.parametrize("kind,dimensions", [("plain", 1), ("plain", 2), ("plain", 3), ("concentrated", 64)])
def test_few_or_few_filled_dimensions_against_brute_force(spark, kind, dimensions):
    rng = np.random.default_rng(dimensions)
    v, w = pairs(kind, dimensions, 60, rng) if dimensions > 1 else (rng.standard_normal((60, 1)),) * 2
    v, w = v.astype(np.float32), (w + 0.03 * rng.standard_normal(w.shape) * np.abs(w)).astype(np.float32)
    rows = [(k, x.tolist(), 1) for k, x in enumerate([*v, *w])]
    want, got = brute(rows), run(spark, rows)
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want) and all(g[1] <= b[1] for g, b in zip(got, want, strict=True))


def test_the_book_grows_with_the_table():
    assert [caps.codes_for(n) for n in (0, 65_536, 65_537, 10**6, 10**9)] == [16, 16, 32, 32, 256]
