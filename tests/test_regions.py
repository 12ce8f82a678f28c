"""Regions of several rings, correlated densities, and discs known by their members, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_golden import make_points

from geopulse.functions.grid import GridSpec
from geopulse.functions.tables import written
from geopulse.operators import correlated, geometry, graph, regions, scan, scan_sets

RING = "region_id long, ring_id long, seq int, x double, y double"


def star(rng, cx, cy, r, n):
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    return [(cx + r * f * math.cos(a), cy + r * f * math.sin(a)) for a, f in zip(angles, rng.uniform(0.4, 1, n), strict=True)]


def brute_inside(x, y, rings):
    odd = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a, b) != (c, d) and (c - a) * (y - b) == (d - b) * (x - a) and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d):
                return True
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                odd = not odd
    return odd


def ring_table(spark, shapes):
    return spark.createDataFrame([(k, j, i, float(x), float(y)) for k, rings in shapes.items() for j, ring in enumerate(rings) for i, (x, y) in enumerate(ring)], RING)


def test_places_in_regions_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    shapes = {k: [star(rng, x, y, r, 5 + k % 9), star(rng, x, y, r / 3, 4)] for k, (x, y, r) in enumerate(zip(*rng.uniform(-60, 60, (2, 30)), 2.0 ** rng.uniform(-3, 6, 30), strict=True))}
    shapes[30] = [star(rng, 0, 0, 80, 400)]
    at = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-90, 90, (400, 2)))]
    at += [(1000 + k, *map(float, c)) for k, c in enumerate(shapes[2][0] + shapes[30][0][:20])]  # corners
    places = spark.createDataFrame([*at, (5000, None, 1.0), (5001, 1.0, None)], "event_id long, x double, y double")
    got = {tuple(r) for r in regions.places_in_regions(places, ring_table(spark, shapes), ["event_id"]).collect()}
    assert got == {(k, s) for k, x, y in at for s, rings in shapes.items() if brute_inside(x, y, rings)} and len(got) > 200


def test_holes_islands_and_edges(spark):
    square = lambda r: [(-r, -r), (r, -r), (r, r), (-r, r)]
    rings = ring_table(spark, {7: [square(8), square(4) + square(4)[:1], square(2)], 8: [[(1, 1)]], 9: [[(20, 0), (30, 0)]]})
    places = [(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 4.0, 1.0), (4, 6.0, 0.0), (5, 8.0, 8.0), (6, 9.0, 0.0), (7, 1.0, 1.0), (8, 25.0, 0.0), (9, 25.0, 0.1), (4, 6.0, 0.0)]
    got = regions.places_in_regions(spark.createDataFrame(places, "event_id long, x double, y double"), rings, ["event_id"])
    assert sorted(map(tuple, got.collect())) == [(1, 7), (3, 7), (4, 7), (5, 7), (7, 7), (8, 9)]
    kept = regions.points_in_regions(spark.createDataFrame(places, "event_id long, x double, y double"), rings)
    assert sorted(r.event_id for r in kept.collect()) == [1, 3, 4, 4, 5, 7, 8]
    assert regions.places_in_regions(kept, rings.where("false"), ["event_id"]).isEmpty()


def brute_density(data, at, s, h, w):
    u = at[:, None, :] - data[None]
    q = np.einsum("abi,ij,abj->ab", u, np.linalg.inv(s), u)
    n = data.shape[1]
    return (w * np.exp(-q / 2 / h**2) / h**n).sum(1) / (w.sum() * math.sqrt(np.linalg.det(s)) * (2 * math.pi) ** (n / 2))


@pytest.mark.parametrize("rule", ["scott", "silverman", 0.7, "own"])
def test_density_of_four_dimensions(spark, rule):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    data = rng.normal(size=(70, 4)) @ rng.normal(size=(4, 4)) + 5
    h, w = rng.uniform(0.3, 1, 70), rng.uniform(-1, 1, 70)
    at = data[:9] + 0.3
    dims = ["a", "b", "c", "d"]
    points = spark.createDataFrame([(*map(float, r), float(x), float(y)) for r, x, y in zip(data, h, w, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0, 5.0)], ", ".join(f"{c} double" for c in [*dims, "own", "weight"]))
    places = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(at)], "k int, " + ", ".join(f"{c} double" for c in dims))
    got = correlated.density(points, places, dims, ["k"], F.col("own") if rule == "own" else rule, F.col("weight"))
    width = {"scott": 70 ** (-1 / 8), "silverman": (70 * 6 / 4) ** (-1 / 8), "own": h}.get(rule, rule)
    want = brute_density(data, at, np.cov(data.T), width, np.abs(w))
    assert [r.density for r in got.orderBy("k").collect()] == pytest.approx(want.tolist(), rel=1e-9)


def test_density_of_a_given_covariance_and_of_a_line(spark):
    data = np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [4.0, 4.0]])
    points = spark.createDataFrame([tuple(map(float, r)) for r in data], "x double, y double")
    places = spark.createDataFrame([(0, 1.0, 0.5)], "k int, x double, y double")
    s = [[2.0, 0.5], [0.5, 1.0]]
    got = correlated.density(points, places, ["x", "y"], ["k"], 0.8, covariance=s).head().density
    assert got == pytest.approx(brute_density(data, np.array([[1.0, 0.5]]), np.array(s), 0.8, np.ones(4))[0])
    with pytest.raises(Exception, match="not positive"):
        correlated.density(points, places, ["x", "y"], ["k"]).collect()
    with pytest.raises(ValueError, match="no rule"):
        correlated.density(points, places, ["x", "y"], ["k"], "other")


def brute_cloud(x, y, s, h):
    values, vectors = np.linalg.eigh(s)
    root = vectors @ np.diag(np.sqrt(values)) @ vectors.T
    for i in range(10):
        r = h * math.sqrt(-2 * math.log(1 - (i + 0.5) / 10))
        for a in range(100):
            u = root @ [r * math.cos(2 * math.pi * a / 100), r * math.sin(2 * math.pi * a / 100)]
            yield x + u[0], y + u[1]


def test_edge_factors(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(50, 2)) @ [[3.0, 1.0], [0.0, 2.0]]
    points = spark.createDataFrame([tuple(map(float, r)) for r in data], "x double, y double")
    shapes = {1: [star(rng, 0, 0, 4, 9), star(rng, 0, 0, 1, 5)], 2: [star(rng, 1, 1, 6, 7)]}
    at = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-4, 4, (25, 2)))]
    places = spark.createDataFrame(at, "k int, x double, y double")
    got = {(r.k, r.region_id): r.factor for r in correlated.region_factors(points, places, ["k"], ring_table(spark, shapes)).collect()}
    s, h = np.cov(data.T), 50 ** (-1 / 6)
    want = {(k, j): sum(brute_inside(*c, rings) for c in brute_cloud(x, y, s, h)) / 1000 for k, x, y in at for j, rings in shapes.items() if brute_inside(x, y, rings)}
    assert got.keys() == want.keys() and len(want) > 5 and all(got[k] == pytest.approx(want[k], abs=2e-3) for k in want)

    grid = GridSpec(2.0, 1.5, -4.0, -3.0, 4, 4)
    cells = {(0, 0), (1, 0), (1, 1), (2, 3), (3, 3)}
    valid = spark.createDataFrame(sorted(cells), "gx long, gy long")
    cell = lambda x, y: (math.floor((x + 4) / 2), math.floor((y + 3) / 1.5))
    share = lambda x, y: sum(cell(*c) in cells for c in brute_cloud(x, y, s, h)) / 1000
    factors = {r.k: r.factor for r in correlated.mask_factors(points, places, ["k"], valid, grid).collect()}
    assert all(factors[k] == pytest.approx(share(x, y), abs=2e-3) for k, x, y in at)
    risks = {(r.gx, r.gy): r.risk for r in correlated.corrected_surface(points, valid, grid, samples=2).collect()}
    for gx, gy in cells:
        subs = np.array([(-4 + (gx + (i + 0.5) / 2) * 2, -3 + (gy + (j + 0.5) / 2) * 1.5) for i in range(2) for j in range(2)])
        dense = brute_density(data, subs, s, h, np.ones(50))
        assert risks[gx, gy] == pytest.approx(np.mean([d / share(*p) for d, p in zip(dense, subs, strict=True)]), rel=2e-2)


def brute_sets(places, radius, most, ties):
    """The first disc (centre, d2) of each set of members, in the order of centres and radii."""
    first = {}
    for c in sorted({min(k for k, q in places.items() if q == p) for p in places.values()}):
        d2 = {k: (places[c][0] - x) ** 2 + (places[c][1] - y) ** 2 for k, (x, y) in places.items()}
        for d in sorted({v for v in d2.values() if v <= radius * radius}):
            if not ties:
                edge = d * (scan_sets.MARGIN * scan_sets.MARGIN)
                found = [(edge, frozenset(k for k in d2 if d2[k] <= edge))]
            else:
                inner = frozenset(k for k in d2 if d2[k] < d)
                tied = sorted({min(k for k, q in places.items() if q == places[i]) for i in d2 if d2[i] == d})
                found = []
                for mask in range(1, 1 << len(tied)):
                    at = {places[t] for b, t in enumerate(tied) if mask >> b & 1}
                    found.append((d, inner | {k for k, q in places.items() if q in at}))
                found.sort(key=lambda f: len(f[1]))  # stable: by size, then mask
            for edge, members in found:
                if 1 < len(members) <= most:
                    first.setdefault(members, (c, edge))
    return first


def set_points(spark, n=44, side=7):
    rng = np.random.default_rng(21)
    at = [(float(x), float(y)) for x, y in rng.integers(0, side, (n, 2))]
    at[3] = (at[2][0] + 3.00001, at[2][1])  # just beyond a disc of radius 3, within its margin
    days = rng.permutation(n)
    pts = make_points(spark, [(f"2017-{1 + d // 28:02d}-{1 + d % 28:02d}", *p) for d, p in zip(days.tolist(), at, strict=True)])
    ids = {(r.ts.timetuple().tm_yday, r.x, r.y): r.event_id for r in pts.collect()}
    places = {ids[1 + d + (3 if d >= 28 else 0), *p]: p for d, p in zip(days.tolist(), at, strict=True)}
    ages = {ids[1 + d + (3 if d >= 28 else 0), *p]: float((max(days) + (3 if max(days) >= 28 else 0)) - d - (3 if d >= 28 else 0)) for d, p in zip(days.tolist(), at, strict=True)}
    return pts, places, ages


@pytest.mark.parametrize("ties", [False, True])
def test_discs_of_equal_members_count_once(spark, ties):
    pts, places, ages = set_points(spark)
    n, radius, max_age = len(places), 3.0, 20.0
    want = {}
    for members, (c, edge) in brute_sets(places, radius, n / 2, ties).items():
        best = None
        for t in sorted({ages[k] for k in members if ages[k] <= max_age}, reverse=True):
            time = sum(a <= t for a in ages.values())
            actual, mean = sum(ages[k] <= t for k in members), len(members) * time / n
            if 2 * time <= n and actual > 1 and actual > mean:
                value = actual * math.log(actual / mean) + ((n - actual) * math.log((n - actual) / (n - mean)) if n > actual else 0)
                if best is None or value > best[0]:
                    best = value, t, actual
        if best:
            want.setdefault((c, round(edge, 6), len(members)), []).append((round(best[0], 9), best[1], best[2]))
    found = scan_sets.set_candidates(pts, radius, max_age, ties)
    got = {}
    for r in found.collect():
        got.setdefault((r.centre, round(r.d2, 6), r.space_count), []).append((round(r.statistic, 9), r.age, r.actual))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(want) > 20
    assert scan.clusters(found, pts).count() > 1


@pytest.mark.parametrize("kind,border", [("set_points", 1), ("scattered", 16)])
def test_leading_sets_give_the_clusters_of_all_sets(spark, monkeypatch, kind, border):
    monkeypatch.setattr(scan_sets, "BORDER", border)
    rng = np.random.default_rng(3)
    scattered = [(f"2017-01-{d:02d}", *map(float, p)) for d, p in zip(rng.integers(1, 29, 150).tolist(), rng.normal(0, 4, (150, 2)), strict=True)]
    pts = set_points(spark)[0] if kind == "set_points" else make_points(spark, scattered)
    pts = written(pts.unionAll(pts.withColumn("event_id", F.col("event_id") + 1000)))  # each place twice
    found = scan_sets.set_candidates(pts, 3.0, 20.0)
    monkeypatch.delattr(scan_sets, "around")  # the table of pairs
    some = written(scan_sets.leading_sets(pts, 3.0, 20.0))
    want = found.toPandas().sort_values(["centre", "d2"])
    want = want[want["statistic"] > want.groupby("centre")["statistic"].transform(lambda s: s.cummax().shift(fill_value=0.0)) + 1e-9]
    rows = lambda df: sorted((r.centre, round(r.d2, 9), r.age, r.space_count, r.time_count, r.actual, round(r.statistic, 9)) for r in df.itertuples())
    assert rows(some.toPandas()) == rows(want) and len(want) > 20
    all_sets, leading = ([(r.rank, r.centre, round(r.radius, 9), r.age) for r in scan.clusters(f, pts).orderBy("rank").collect()] for f in (found, some))
    assert leading == all_sets and len(leading) > 1
    assert scan_sets.leading_sets(pts.where("false"), 3.0, 20.0).isEmpty() and scan_sets.leading_sets(pts.limit(1), 3.0, 20.0).isEmpty()


def test_discs_of_no_events(spark):
    pts, _, _ = set_points(spark)
    for ties in (False, True):
        assert scan_sets.set_candidates(pts.where("false"), 3.0, 5.0, ties).isEmpty()
        assert scan_sets.set_candidates(pts.limit(1), 3.0, 5.0, ties).isEmpty()


def test_grid_over_points(spark):
    grid = GridSpec(10.0, 20.0, 3.0, 4.0)
    pts = make_points(spark, [("2017-01-01", -1.0, 4.0), ("2017-01-02", 33.0, 63.0)])
    found = geometry.grid_over_points(pts, grid)
    assert (found.xoffset, found.yoffset, found.xextent, found.yextent) == (-7.0, 4.0, 5, 3)
    assert geometry.grid_over_points(pts.where("false"), grid).xextent == 0


def test_paths_meet_at_ends_only(spark):
    paths = {0: [(0, 0), (1, 1), (2, 0)], 1: [(2, 0), (1, 1), (0, 0)], 2: [(1, 1), (5, 5)], 3: [(7, 7)], 4: [(7, 7), (8, 8), (7, 7)]}
    lines = spark.createDataFrame([(k, i, float(x), float(y)) for k, p in paths.items() for i, (x, y) in enumerate(p)], "line_id long, seq int, x double, y double")
    vertices, edges = graph.from_paths(lines)
    assert sorted(tuple(r) for r in vertices.collect()) == [(1, 0, 0), (2, 1, 1), (3, 2, 0), (5, 1, 1), (8, 5, 5), (9, 7, 7), (11, 8, 8)]
    assert sorted((r.k1, r.k2) for r in edges.collect()) == [(1, 2), (2, 3), (2, 8), (3, 5), (5, 1), (9, 11), (11, 9)]
