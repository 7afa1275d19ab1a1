import random

import numpy as np
import pytest

from ruamesh.operators import spatial as S


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(S, "PER_CELL", 20)
    monkeypatch.setattr(S, "PER_SLOT", 3)


def cloud(n, seed=1, size=1000.0):
    rng = random.Random(seed)
    return [(i, rng.choice([500.0, rng.random() * size, rng.gauss(200, 5)]), rng.random() * size if i % 7 else 300.0) for i in range(n)]


@pytest.mark.parametrize("metric", ["plane", "sphere"])
def test_tree_against_brute_force(metric):
    rng = np.random.default_rng(2)
    pts, qs = rng.uniform(-60, 60, (400, 2)), rng.uniform(-60, 60, (80, 2))
    pts[50:90] = pts[50]
    tree = S.VPTree(pts, metric)
    d = S.METRICS[metric](qs[:, None], pts[None])
    r = np.quantile(d, 0.03, axis=1)
    q, p = tree.within(qs, r)
    assert set(zip(q.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= r[:, None]))))
    best, dist = tree.nearest(qs)
    assert np.allclose(dist, d.min(axis=1)) and np.allclose(d[np.arange(80), best], dist)


def test_near_pairs(spark):
    pts = cloud(600) + [(7, 500.0, 300.0), (9001, 500.0, 300.0), (9002, None, 1.0), (9003, float("nan"), 1.0), (9001, 500.0, 300.0)]
    df = spark.createDataFrame(pts, "id bigint, x double, y double")
    good = [p for p in pts if p[1] is not None and p[1] == p[1]]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in good for b in good if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 25**2}
    got = [tuple(r) for r in S.near_pairs(df, 25.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_with_ties(spark):
    pts, goals = cloud(300, 3), [*cloud(200, 4), (-5, 500.0, 300.0), (-7, 500.0, 300.0)]
    a, b = spark.createDataFrame(pts, "id bigint, x double, y double"), spark.createDataFrame(goals, "target bigint, x double, y double")
    want = {i: min(((x - u) ** 2 + (y - v) ** 2, k) for k, u, v in goals) for i, x, y in pts}
    got = {r["id"]: (r["target"], r["dist"]) for r in S.nearest(a, b).collect()}
    assert set(got) == set(want) and all(got[i][0] == want[i][1] and abs(got[i][1] ** 2 - want[i][0]) < 1e-6 for i in want)


def test_near_between(spark):
    pts, goals = cloud(300, 3), [*cloud(200, 4), (5, None, 1.0)]
    a, b = spark.createDataFrame(pts, "id bigint, x double, y double"), spark.createDataFrame(goals, "target bigint, x double, y double")
    want = {(i, k) for i, x, y in pts for k, u, v in goals if u is not None and (x - u) ** 2 + (y - v) ** 2 <= 900}
    got = S.near_between(a, b, 30.0).collect()
    assert len(got) == len(want) and {(r["id"], r["target"]) for r in got} == want
    assert S.near_between(a.limit(0), b, 30.0).count() == 0 and S.near_between(a, b.limit(0), 30.0).count() == 0


def ring(*p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def test_regions(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    holed = [ring((20, 0), (30, 0), (30, 10), (20, 10)), ring((22, 2), (28, 2), (28, 8), (22, 8), (22, 2))]
    regions = [(1, [square]), (2, holed), (3, [square[::-1]]), (4, None), (5, [square[:2]]), (6, [])]
    pts = [(1, 5.0, 5.0), (2, 0.0, 5.0), (3, 21.0, 1.0), (4, 25.0, 5.0), (5, 10.0, 10.0), (6, 99.0, 9.0), (7, None, None), (1, 5.0, 5.0)]
    p = spark.createDataFrame(pts, "id bigint, x double, y double")
    r = spark.createDataFrame(regions, "region bigint, rings array<array<struct<x: double, y: double>>>")
    assert sorted(map(tuple, S.regions_of(p, r).collect())) == [(1, 1), (1, 3), (3, 2)]


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, x double, y double")
    one = spark.createDataFrame([(1, 0.0, 0.0)], "id bigint, x double, y double")
    assert S.near_pairs(none, 5.0).count() == 0 and S.near_pairs(one, 5.0).count() == 0
    assert S.nearest(one, none.withColumnRenamed("id", "target")).count() == 0
    assert S.nearest(none, one.withColumnRenamed("id", "target")).count() == 0


@pytest.mark.parametrize("most", [4096, 2])
def test_regions_in_degrees_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(S, "EXACT_PIVOTS", most)
    rng = np.random.default_rng(5)
    at = np.column_stack([rng.uniform(-51.3, -51.0, 900), rng.uniform(-30.6, -30.3, 900)])
    corners = [(x, y, x + rng.uniform(0.001, 0.05), y + rng.uniform(0.001, 0.05)) for x, y in at[rng.integers(0, 900, 120)] - 0.002]
    regions = [(k, [ring((a, b), (c, b), (c, d), (a, d))]) for k, (a, b, c, d) in enumerate(corners)]
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)], "id bigint, x double, y double")
    r = spark.createDataFrame(regions, "region bigint, rings array<array<struct<x: double, y: double>>>")
    want = {(i, k) for i, (x, y) in enumerate(at) for k, (a, b, c, d) in enumerate(corners) if a < x < c and b < y < d}
    got = [tuple(x) for x in S.regions_of(p, r).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_inside_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    turn = np.sort(rng.uniform(0, 2 * np.pi, 300))
    v = np.column_stack([np.cos(turn), np.sin(turn)]) * rng.uniform(0.4, 1.0, 300)[:, None]
    e = np.column_stack([v, np.roll(v, -1, axis=0)])
    p = np.concatenate([rng.uniform(-1, 1, (2000, 2)), v[:50], (e[:50, :2] + e[:50, 2:]) / 2])
    whole = S.inside(p[:, 0], p[:, 1], e)
    monkeypatch.setattr(S, "MAX_CROSSINGS", 1000)
    assert (S.inside(p[:, 0], p[:, 1], e) == whole).all() and 0 < whole.sum() < 2000 and not whole[2000:2050].any()


def test_many_pivots(spark, monkeypatch):
    monkeypatch.setattr(S, "EXACT_PIVOTS", 2)
    test_near_pairs(spark)
    test_nearest_with_ties(spark)
