"""Queries over all events against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_catalog import SF
from test_golden import make_points, surface_of

from geopulse.functions.grid import GridSpec
from geopulse.functions.tables import written
from geopulse.operators import evaluate, graph, hotspot, knox, network, scan, sepp, surface
from geopulse.plans import catalog
from geopulse.sources import tables

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def test_knox_pvalue_covers_all_events(spark, duck):
    got = {(r.space_bin, r.time_bin): (r.statistic, r.pvalue) for r in catalog.queries()["knox_pvalue"](spark, SF).collect()}
    want = {(a, b): n for a, b, n in duck.sql(catalog.oracle_sql()["knox_statistic"]).fetchall()}
    assert {k: s for k, (s, _) in got.items()} == want and all(0 <= p < 1 for _, p in got.values())


def test_knox_permutations_of_equal_times(spark):
    pts = make_points(spark, [("2017-01-01 01:00:00", 1.0, float(k)) for k in range(6)])
    got = knox.knox_pvalues(pts, [(0.0, 1.0), (0.0, 2.0)], [(0, 5)], 4).collect()
    assert sorted((r.space_bin, r.statistic, r.pvalue, tuple(r.distribution)) for r in got) == [(0, 5, 0.8, (5,) * 4), (1, 9, 0.8, (9,) * 4)]


@pytest.mark.parametrize("block", [3, 512])
def test_knox_counts_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knox, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(f"2017-01-{d:02d}", float(x), float(y)) for d, (x, y) in zip(rng.integers(1, 28, 120).tolist(), rng.integers(-9, 9, (120, 2)).tolist(), strict=True)]
    day, space, time = 86_400_000_000, [(0.0, 2.0), (1.0, 3.0), (0.0, 3.0)], [(0, 86_400_000_000), (2 * 86_400_000_000, 9 * 86_400_000_000)]
    at = [(int(ts[-2:]) * day, x, y) for ts, x, y in rows]
    pairs = [(math.hypot(a[1] - b[1], a[2] - b[2]), abs(a[0] - b[0])) for k, a in enumerate(at) for b in at[:k]]
    want = {(i, j): sum(lo <= d <= hi and t0 <= g <= t1 for d, g in pairs) for i, (lo, hi) in enumerate(space) for j, (t0, t1) in enumerate(time)}
    assert {(r.space_bin, r.time_bin): r.statistic for r in knox.knox_statistic(make_points(spark, rows), space, time).collect()} == want


def test_pairs_of_points_in_small_files_are_not_broadcast(spark):
    pts = make_points(spark, [("2017-01-01", float(k), 0.0) for k in range(9)])
    plan = knox.close_pairs(pts, 1.0)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_neighbours_are_not_broadcast(spark):
    plan = hotspot.knn_distance(make_points(spark, [("2017-01-01", float(k), 0.0) for k in range(40)]), 3)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def brute_scan(rows, radius, max_age):
    """The best statistic of each centre over all its discs and all ages of the table; rows: (x, y, age)."""
    n, out = len(rows), {}
    ages = sorted({a for _, _, a in rows if a <= max_age and 2 * sum(b <= a for _, _, b in rows) <= n})
    for c, (x, y, _) in enumerate(rows):
        near = [((x - u) ** 2 + (y - v) ** 2, a) for u, v, a in rows]
        for d in sorted({d for d, _ in near if d <= radius * radius}):
            space = sum(e <= d for e, _ in near)
            for t in ages:
                actual, time = sum(e <= d and a <= t for e, a in near), sum(a <= t for _, _, a in rows)
                mean = space * time / n
                if 1 < space <= n / 2 and actual > 1 and actual > mean:
                    rest = (n - actual) * math.log((n - actual) / (n - mean)) if n > actual else 0
                    out[c] = max(out.get(c, 0), actual * math.log(actual / mean) + rest)
    return out


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_scan_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rng = np.random.default_rng(4)
    days = rng.permutation(40)
    places = [(float(a), float(b)) for a, b in rng.integers(0, 12, (40, 2))]
    pts = make_points(spark, [(f"2017-{1 + d // 28:02d}-{1 + d % 28:02d}", *p) for d, p in zip(days.tolist(), places, strict=True)])
    got = {r.centre: r.statistic for r in scan.best_per_centre(scan.scan_candidates(pts, 5.0, 12.0)).collect()}
    want = brute_scan([(*p, float(max(days) - d)) for d, p in zip(days.tolist(), places, strict=True)], 5.0, 12.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("coarse,centres,small", [(1, 3, 0), (4, 1000, 0), (64, 1000, 1 << 16)])
def test_leading_discs_give_what_all_discs_give(spark, monkeypatch, coarse, centres, small):
    monkeypatch.setattr(scan, "COARSE", coarse)
    monkeypatch.setattr(scan, "SMALL", small)
    monkeypatch.setattr(scan, "CENTRES", centres)
    rng = np.random.default_rng(8)
    places = np.concatenate([rng.integers(0, 12, (60, 2)), rng.normal(5, 1, (60, 2))]).tolist()
    pts = make_points(spark, [(f"2017-01-{d:02d}", *map(float, p)) for d, p in zip(rng.integers(1, 29, 120).tolist(), places, strict=True)])
    found, some = scan.scan_candidates(pts, 5.0, 9.0).toPandas(), scan.leading_candidates(pts, 5.0, 9.0).toPandas()
    want = found.sort_values(["centre", "d2"])
    want = want[want["statistic"] > want.groupby("centre")["statistic"].transform(lambda s: s.cummax().shift(fill_value=0.0))]
    rows = lambda df: sorted((r.centre, r.d2, r.age, r.space_count, r.time_count, r.actual, round(r.statistic, 9)) for r in df.itertuples())
    assert rows(some) == rows(want) and 120 < len(some) < len(found)
    all_discs, leading = (scan.clusters(spark.createDataFrame(df), pts).orderBy("rank").collect() for df in (found, some))
    assert [(r.rank, r.centre, r.radius, r.age) for r in leading] == [(r.rank, r.centre, r.radius, r.age) for r in all_discs]


def test_events_of_one_place_have_one_centre(spark):
    rng = np.random.default_rng(2)
    pts = make_points(spark, [(f"2017-01-{d:02d}", float(x), float(y)) for d, x, y in rng.integers([1, 0, 0], [29, 9, 9], (60, 3))])
    pts = written(pts.unionAll(pts.withColumn("event_id", F.col("event_id") + 1000)))
    found, once = scan.leading_candidates(pts, 3.0, 9.0), scan.leading_candidates(pts, 3.0, 9.0, each=False).toPandas()
    assert 2 * len(once) <= found.count() and once["centre"].max() < 1000
    chosen = [[(r.centre, r.radius, r.age) for r in scan.clusters(f, pts).orderBy("rank").collect()] for f in (found, spark.createDataFrame(once))]
    assert chosen[0] == chosen[1]


@pytest.mark.parametrize("settled", [0, 40, 1 << 16])
def test_clusters_take_all_discs(spark, monkeypatch, settled):
    """Against the greedy choice over all candidates."""
    monkeypatch.setattr(scan, "SETTLED", settled)
    rng = np.random.default_rng(11)
    at = np.concatenate([rng.normal((a, b), 1.5, (9, 2)) for a, b in rng.integers(0, 30, (9, 2))])
    pts = make_points(spark, [(f"2017-01-{1 + int(d):02d}", float(x), float(y)) for (x, y), d in zip(at, rng.integers(0, 28, len(at)), strict=True)])
    found = scan.scan_candidates(pts, 6.0, 12.0)
    left = sorted(((-round(r.statistic, 9), math.sqrt(r.d2), r.age, r.centre) for r in found.collect()))
    want = []
    while left:
        best = left[0]
        want.append(best)
        x, y = at[best[3]]
        left = [c for c in left if (at[c[3]][0] - x) ** 2 + (at[c[3]][1] - y) ** 2 > (c[1] + best[1]) ** 2]
    got = scan.clusters(found, pts)
    assert [(r.rank, r.centre) for r in got.orderBy("rank").collect()] == [(k + 1, c[3]) for k, c in enumerate(want)] and len(want) > 3
    aged = scan.with_age(pts, None, 86_400_000_000)
    ages = {r.event_id: r.age for r in aged.collect()}
    for r in scan.maximal(got, aged).collect():
        d = np.hypot(at[:, 0] - r.cx, at[:, 1] - r.cy)
        radius = want[r["rank"] - 1][1]
        free = [x for i, x in enumerate(d.tolist()) if x > radius * (1 + 1e-9) and ages[i] <= r.age]
        assert r.radius == pytest.approx(min(free, default=radius))


def test_scan_risk_falls_from_cluster_to_cluster_and_to_the_edge(spark):
    grid = GridSpec(1.0, 1.0, 0.0, 0.0, 8, 3)
    found = spark.createDataFrame([(1, 9, 1.5, 1.5, 1.0, 2.0, 5.0), (2, 8, 5.5, 0.5, 1.0, 2.0, 3.0)], "rank int, centre long, cx double, cy double, radius double, age double, statistic double")
    got = {(r.gx, r.gy): r.risk for r in scan.scan_surface(found, grid.cells(spark), grid).collect()}
    want = {(1, 1): 2.0, (1, 0): 1.2, (0, 1): 1.4, (2, 1): 1.6, (1, 2): 1.8, (5, 0): 1.0, (4, 0): 0.25, (6, 0): 0.5, (5, 1): 0.75}
    assert got == {(x, y): pytest.approx(want.get((x, y), 0.0)) for x in range(8) for y in range(3)}
    places = spark.createDataFrame([(0, 1.5, 1.5), (1, 1.5, 2.6), (2, 5.5, 0.5), (3, 2.0, 1.5)], "place_id long, x double, y double")
    risk = {r.place_id: r.risk for r in scan.continuous_risk(found, places).collect()}
    assert risk[1] == 0 and risk[0] > risk[3] > risk[2] > 0


def test_scan_p_values_of_permutations(spark):
    pts = make_points(spark, [(f"2017-01-{1 + k:02d}", 0.1 * k if k > 15 else 50.0 * k, 0.0) for k in range(20)])
    row = scan.scan_monte_carlo(pts, 3, radius=3.0, max_age=5.0).head()
    assert row.statistic > 0 and row.pvalue in (0.0, 0.25, 0.5, 0.75)


def test_nodes_across_a_cell_border_are_merged(spark):
    nodes = spark.createDataFrame([(5, 0.049, 0.0), (3, 0.051, 0.0), (9, 3.0, 3.0), (7, 0.13, 0.0), (8, 0.3, 0.0)], "node_id long, x double, y double")
    assert {r.node_id: r.key for r in graph.merge_nodes(nodes, 0.1).collect()} == {5: 3, 3: 3, 7: 3, 8: 8, 9: 9}


def test_long_walks_go_on(spark):
    edges = spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(12)], "edge_id long, k1 long, k2 long, length double")
    got = graph.walks_with_degrees(edges, 1, 0, 100.0, 50.0).collect()
    assert sorted(r.length for r in got) == [float(k) for k in range(11)]


def test_broken_ties_are_the_same_in_any_partitions(spark):
    s = surface_of(spark, [[1.0, 1.0, 2.0], [2.0, 2.0, 1.0]])
    one, two = ({(r.gx, r.gy): r.risk for r in surface.break_ties(x, 3).collect()} for x in (s.coalesce(1), s.repartition(5)))
    assert one == two and len(set(one.values())) == 6 and max(one.values()) < 2 + 1e-8


def test_coverage_runs_over_ranges(spark):
    edges = spark.createDataFrame([(k, k, k + 1, float(1 + k % 3)) for k in range(50)], "edge_id long, k1 long, k2 long, length double")
    risks = spark.createDataFrame([(k, float(k * 7 % 10)) for k in range(50)], "edge_id long, risk double")
    order, total, want = sorted(range(50), key=lambda k: (-(k * 7 % 10), k)), sum(1 + k % 3 for k in range(50)), set()
    upto = 0
    for k in order:
        upto += 1 + k % 3
        if upto <= total * 0.4:
            want.add(k)
    assert {r.edge_id for r in network.coverage(risks, edges, 0.4).collect()} == want


@pytest.mark.parametrize(("layout", "stamp", "hour"), [("snapshot", "03/09/2014 01:05:00 PM", 13), ("gen", "3/9/2014 11:05:00 AM", 11), ("all_other", "3/9/14 5:05", 5)])
def test_times_of_the_layouts(spark, tmp_path, layout, stamp, hour):
    kind, x, y, t = tables.LAYOUTS[layout]
    path = tmp_path / "events.csv"
    path.write_text(f"{kind},{x},{y},{t}\nTHEFT,10,20,{stamp}\nTHEFT,,20,{stamp}\nOTHER,1,2,{stamp}\n")
    (row,) = tables.csv_events(spark, str(path), {"THEFT"}, layout, metres=False).collect()
    assert (row.ts.year, row.ts.month, row.ts.day, row.ts.hour, row.ts.minute, row.x, row.y) == (2014, 3, 9, hour, 5, 10.0, 20.0)
    path.write_text(f"{kind},{x},{y},{t}\nTHEFT,10,20,yesterday\n")
    with pytest.raises(Exception, match="unreadable time"):
        tables.csv_events(spark, str(path), {"THEFT"}, layout).collect()


def test_scan_files_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.0, 3.0), (4.0, 5.0, 1.0)], "x double, y double, t double")
    tables.write_scan_files(pts, str(tmp_path / "s"))
    got = sorted((r.x, r.y, r.age) for r in tables.scan_files(spark, str(tmp_path / "s"), 10.0).collect())
    assert got == [(1.0, 2.0, 7.0), (1.0, 2.0, 7.0), (4.0, 5.0, 9.0)]


def test_neighbour_distances_of_any_density(spark):
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.random((60, 2)), 1000 * rng.random((20, 2)), [[5e4, 5e4]]])
    got = {r.event_id: r.distance for r in hotspot.knn_distance(make_points(spark, [("2017-01-01", *p) for p in at.tolist()]), 7).collect()}
    d = np.sort(np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)), axis=1)[:, 7]
    assert got == {i: pytest.approx(x) for i, x in enumerate(d.tolist())}


@pytest.mark.parametrize("omega", [1 / 1440, 0.5, 0.1])
def test_em_step_against_full_matrix(spark, omega):
    rng = np.random.default_rng(8)
    hours = np.sort(np.concatenate([rng.integers(0, 1000, 40), [0, 0, 5, 5, 5]]))
    pts = make_points(spark, [(f"2017-{1 + h // 672:02d}-{1 + h // 24 % 28:02d} {h % 24:02d}:00:00", 5.0 + 50 * (k % 2), 5.0) for k, h in enumerate(hours.tolist())])
    events = sepp.grid_events(pts, GridSpec(50.0, 50.0, 0.0, 0.0, 2, 1))
    start = {(0, 0): 0.001, (1, 0): 0.002}
    mu = spark.createDataFrame([(*c, m) for c, m in start.items()], "gx long, gy long, mu double")
    got = sepp.em_step(events, omega, 0.5, mu, 6e4)
    p = {(r.i, r.j): r.p for r in sepp.p_matrix(events, sepp.trigger_pairs(events), omega, 0.5, mu).collect()}
    cells, s, st, n = {c: [] for c in start}, 0.0, 0.0, 0
    for r in events.collect():
        cells[r.gx, r.gy].append((r.t, r.event_id))
    for c, times in cells.items():
        own = 0.0
        for t, j in times:
            g = [(t - a, i, 0.5 * omega * math.exp(-omega * (t - a))) for a, i in times if a < t]
            total = start[c] + sum(x for *_, x in g)
            assert p.pop((j, j)) == pytest.approx(start[c] / total)
            for dt, i, x in g:
                assert p.pop((i, j)) == pytest.approx(x / total, rel=1e-9, abs=1e-300)
                s, st = s + x / total, st + dt * x / total
            own, n = own + start[c] / total, n + 1
        assert {(r.gx, r.gy): r.mu for r in got[2].collect()}[c] == pytest.approx(own / 6e4)
    assert not p and got[:2] == (pytest.approx(s / st), pytest.approx(s / n))


def test_poisson_score_of_full_cells(spark):
    counts, risks = [900, 450, 0], [0.25, 0.74, 0.01]
    pts = make_points(spark, [("2017-01-01", x + 0.5, 0.5) for x, n in enumerate(counts) for _ in range(n)])
    want = 0.0
    for n, p in zip(counts, risks, strict=True):
        mean, f = p * sum(counts), 0.0
        for k in range(5000):
            f += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            want += f * f if k < n else (1 - f) ** 2
    got = evaluate.poisson_crps(surface_of(spark, [risks]), pts, GridSpec(1.0, 1.0, 0.0, 0.0, 3, 1)).head().crps
    assert got == pytest.approx(want, rel=1e-9)
