import math

import numpy as np
import pytest

from facetry.llm import near_vectors as nv


def brute(rows, least):
    """Links, components and kept flags by comparing every pair."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for n, i in enumerate(good):
        for j in good[n + 1:]:
            a, b = (np.array(rows[k][1], np.float64) / max(map(abs, rows[k][1])) for k in (i, j))  # no square may overflow
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, links[i], component, vec_id == component))
    return out


def cloud(rng, n, size, noise):
    """Vectors near few centres, so cosines spread around the threshold."""
    centres = rng.standard_normal((max(1, n // 12), size))
    x = centres[rng.integers(0, len(centres), n)] + rng.uniform(0, noise, (n, 1)) * rng.standard_normal((n, size))
    return np.float32(x * rng.uniform(0.1, 9, (n, 1)))


def check(spark, rows, least=0.95, kind="float"):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, key string").repartition(3)
    got = [tuple(r) for r in nv.near_vectors(df, least).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, least)))


@pytest.mark.parametrize("size,least,noise", [(64, 0.95, 0.4), (12, 0.9, 0.5), (3, 0.99, 0.3), (1, 0.5, 1.0)])
def test_equals_all_pairs(spark, size, least, noise):
    rng = np.random.default_rng(size)
    x = cloud(rng, 150, size, noise)
    check(spark, [(int(i), v.tolist()) for i, v in enumerate(x)], least)


def test_chunks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(nv, "CHUNK", 20)
    monkeypatch.setattr(nv, "TILE", 7)
    rng = np.random.default_rng(9)
    x = np.concatenate((cloud(rng, 60, 16, 0.4), np.float32(1 + 0.12 * rng.standard_normal((90, 16)))))
    check(spark, [(int(i), v.tolist()) for i, v in enumerate(x)])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (9, [1.0, 2.0]), (9, [-1.0, 2.0]),
            (None, [1.0, 2.0]), (None, [5.0, -3.0]), (11, [5.0, -3.0]), (None, [7.0, 7.0, 7.0]), (13, [1e-30, 2e-30]), (14, [3e38, 3e38]), (15, [-0.0, 1.0]), (16, [0.0, 1.0]), (17, [2.0, 1.0, 1.0])]
    check(spark, rows)
    check(spark, [(i, v) for i, v in rows if i != 14] + [(18, [1e300, 2e300])], kind="double")


def test_empty_table_and_bad_threshold(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nv.near_vectors(none).collect() == []
    with pytest.raises(ValueError):
        nv.near_vectors(none, 0.0)


def test_blocks_cover_all_coordinates_and_budgets_add_up():
    for size in (1, 3, 8, 11, 64, 100):
        parts = nv.blocks_of(size)
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(size))
        assert math.isclose(sum(nv.budget(0.95, p.stop - p.start, size) for p in parts), 0.1)
        turn = nv.rotation(size)
        assert np.allclose(turn @ turn.T, np.eye(size))


def test_a_tile_meets_only_what_is_near_it_in_order(monkeypatch):
    rng = np.random.default_rng(4)
    x = nv.unit(rng.standard_normal((700, 16)))
    side = nv._Side(np.arange(700), np.ones(700, int), x, x, slice(0, 8))
    other = nv._Side(np.arange(300), np.ones(300, int), x[:300] + 0.01, x[:300] + 0.01, slice(0, 8))
    monkeypatch.setattr(nv, "TILE", 50)
    met = []
    plain = np.flatnonzero
    monkeypatch.setattr(nv.np, "flatnonzero", lambda m: (met.append(m.size), plain(m))[1])
    for limit in (0.02, 0.2):
        for a, b, same in ((side, side, True), (side, other, False)):
            met.clear()
            got = sorted((int(a.key[i]), int(b.key[j])) for u, v in nv._close(a, b, limit, same) for i, j in zip(u, v, strict=True))
            far = ((a.left[:, None, :8] - b.left[None, :, :8]).astype(float) ** 2).sum(2)
            i, j = np.nonzero(far <= limit)
            assert got == sorted((int(a.key[p]), int(b.key[q])) for p, q in zip(i, j, strict=True) if not same or p < q)
            assert limit > 0.1 or sum(met) < 0.75 * len(a.key) * len(b.key)
