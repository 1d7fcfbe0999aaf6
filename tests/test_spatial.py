import math

import numpy as np
import pytest

from newsgraph.operators import components as CO, spatial as SP

R = 6371.0088


def km(a, b):
    (p, q), (r, s) = np.radians(a), np.radians(b)
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def blobs(seed, n=120):
    """Clumps at the date line, near a pole and elsewhere, with lone points around."""
    rng = np.random.default_rng(seed)
    centres = [(10.0, 179.9), (88.5, 20.0), (-40.0, -70.0), (50.0, 8.0)]
    points = {}
    for i in range(n):
        if i % 10 == 9:
            la, lo = rng.uniform(-80, 80), rng.uniform(-180, 180)
        else:
            la, lo = centres[i % 4] + rng.normal(scale=1.0, size=2)
            lo = (lo + 180) % 360 - 180
        points[round(float(min(la, 90.0)), 3), round(float(lo), 3)] = int(rng.integers(1, 4))
    return points


def frame(spark, points):
    return spark.createDataFrame([(a, b, w) for (a, b), w in points.items()],
                                 "Latitude double, Longitude double, n_events long")


def reference_clusters(points, eps, least):
    keys = sorted(points)
    near = {p: [q for q in keys if km(p, q) <= eps] for p in keys}
    core = {p for p in keys if sum(points[q] for q in near[p]) >= least}
    label, number = {}, 0
    for p in keys:  # sorted order numbers clusters by their smallest core point
        if p in core and p not in label:
            todo = [p]
            while todo:
                x = todo.pop()
                if x in label:
                    continue
                label[x] = number
                todo += [q for q in near[x] if q in core]
            number += 1
    return {p: (p in core, label[p] if p in core else min(
        (label[q] for q in near[p] if q in core), default=-1)) for p in keys}


@pytest.mark.parametrize("seed, eps, least", [(1, 120.0, 6), (2, 60.0, 3), (3, 400.0, 25), (4, 30.0, 2)])
def test_clusters_equal_brute_force(spark, seed, eps, least):
    points = blobs(seed)
    rows = SP.dbscan(frame(spark, points), eps, least).collect()
    got = {(r.Latitude, r.Longitude): (r.is_core, r.cluster) for r in rows}
    want = reference_clusters(points, eps, least)
    assert got == want
    assert len({c for _, c in want.values()}) > 1


def test_cells_touch_only_through_fine_boxes(spark):
    """Two rows of core points whose nearest members are found below the first level."""
    eps = 100.0
    points = {}
    for i in range(25):  # same cells as the rows below, but far ends come first in order
        points[round(0.0 + i * 0.02, 4), round(0.0 + i * 0.02, 4)] = 10
        points[round(0.9 + i * 0.02, 4), round(0.9 - i * 0.02, 4)] = 10
    got = {(r.Latitude, r.Longitude): (r.is_core, r.cluster) for r in SP.dbscan(frame(spark, points), eps, 5).collect()}
    assert got == reference_clusters(points, eps, 5)


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(SP, "CHUNK", 3)
    points = blobs(7, 80)
    rows = SP.eps_neighbours(frame(spark, points), 150.0).collect()
    got = {((r.Latitude, r.Longitude), (r.Other_Latitude, r.Other_Longitude)) for r in rows}
    keys = sorted(points)
    assert got == {(p, q) for i, p in enumerate(keys) for q in keys[i + 1:] if km(p, q) <= 150.0}
    assert len(rows) == len(got)


@pytest.mark.parametrize("start", [1.0, 50.0])
def test_k_distance(spark, start):
    points = blobs(11, 60)
    got = {(r.Latitude, r.Longitude): r.k_distance_km
           for r in SP.k_distance(frame(spark, points), 5, start_km=start).collect()}
    for p in points:
        reach, seen = sorted((km(p, q), points[q]) for q in points), 0
        for d, w in reach:
            seen += w
            if seen >= 5:
                break
        assert got[p] == pytest.approx(d, abs=1e-9)


def test_k_nearest_with_equal_places(spark):
    rows = [("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 1.0), ("d", 0.0, -1.0), ("e", 60.0, 100.0)]
    df = spark.createDataFrame(rows, "Country string, Latitude double, Longitude double")
    near = SP.k_nearest(df, 2, ["Country"]).collect()
    got = {c: [r.o_Country for r in sorted(near, key=lambda r: r["rank"]) if r.Country == c] for c in "abcde"}
    assert got["a"] == ["b", "c"] and got["b"] == ["a", "c"] and got["c"] == ["a", "b"]
    assert len(got["e"]) == 2
    few = SP.k_nearest(df, 9, ["Country"]).collect()
    assert len(few) == 20  # fewer others than asked for: all of them


def test_density(spark):
    points = blobs(13, 40)
    h, step, cut = 300.0, 10.0, 3.0
    got = {(r.Grid_Latitude, r.Grid_Longitude): r.density
           for r in SP.kde_grid(frame(spark, points), step, h, cut).collect()}
    want = {}
    for i in range(18):
        for j in range(36):
            g = (-90 + (i + 0.5) * step, -180 + (j + 0.5) * step)
            ds = [(km(p, g), w) for p, w in points.items()]
            if any(d <= cut * h for d, _ in ds):
                want[g] = sum(w * math.exp(-d * d / 2 / h / h) for d, w in ds if d <= cut * h) / (
                    2 * math.pi * h * h * sum(points.values()))
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-9)


def test_components_on_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)]
    nodes = [(i,) for i in list(range(41)) + list(range(100, 130)) + [500]]
    got = dict(tuple(r) for r in SP.connected_components(
        spark.createDataFrame(nodes, "id long"), spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[500] == 500


def test_components_need_few_rounds(spark, monkeypatch):
    """A chain of 4,096 nodes in random order: its length must not count."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(4096).tolist()
    rounds, state = [], CO._state
    monkeypatch.setattr(CO, "_state", lambda e: (rounds.append(1), state(e))[1])
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    found = CO.stars(edges)
    assert found.count() == 4095 and {r.b for r in found.select("b").distinct().collect()} == {0}
    assert len(rounds) < 25


def test_no_core_points(spark):
    rows = SP.dbscan(frame(spark, {(0.0, 0.0): 1, (50.0, 50.0): 1}), 10.0, 5).collect()
    assert [(r.is_core, r.cluster) for r in rows] == [(False, -1)] * 2


def test_fine_boxes_are_reached(spark, monkeypatch):
    """Cells whose first points are too far apart, with near points, and with none."""
    sides, cell = [], SP._cell
    monkeypatch.setattr(SP, "_cell", lambda side: sides.append(side) or cell(side))
    points = {(0.0, 0.01): 5, (0.2, 0.5): 5, (0.0, 1.02): 5, (0.2, 0.54): 5,  # linked by their near points
              (20.0, 0.01): 5, (20.001, 0.012): 5, (20.0, 1.12): 5, (20.001, 1.122): 5}  # further apart than eps
    got = {(r.Latitude, r.Longitude): (r.is_core, r.cluster)
           for r in SP.dbscan(frame(spark, points), 100.0, 5).collect()}
    assert got == reference_clusters(points, 100.0, 5)
    assert len({c for _, c in got.values()}) == 3
    assert min(sides) <= max(sides) / 4 * (1 + 1e-9)


def test_last_level_compares_points(spark, monkeypatch):
    inner = SP._touching_cells
    monkeypatch.setattr(SP, "_touching_cells", lambda core, eps, side: inner(core, eps, side, last_level=0))
    points = {(0.0, 0.01): 5, (0.2, 0.5): 5, (0.0, 1.02): 5, (0.2, 0.54): 5,
              (20.0, 0.01): 5, (20.001, 0.012): 5, (20.0, 1.12): 5, (20.001, 1.122): 5}
    got = {(r.Latitude, r.Longitude): (r.is_core, r.cluster)
           for r in SP.dbscan(frame(spark, points), 100.0, 5).collect()}
    assert got == reference_clusters(points, 100.0, 5)
