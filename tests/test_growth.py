"""Work that must not grow faster than the events."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopulse.functions.grid import GridSpec
from geopulse.functions.tables import written
from geopulse.operators import geometry, hotspot, knox, mixtures, network, scan, sepp, sepp_kernels
from test_golden import make_points


@pytest.mark.parametrize("masked", [geometry.mask_by_polygon, geometry.cells_by_area])
def test_polygons_are_tested_by_cell_not_by_event(spark, masked):
    grid = GridSpec(1.0, 1.0, 0.0, 0.0, 4, 4)
    pts = make_points(spark, [("2017-01-01", x + 0.5, 1.5) for x in range(4) for _ in range(3)])
    cells = masked(grid.with_cells(pts).groupBy("gx", "gy").count().select("gx", "gy"), grid, [(0.2, 0.2), (1.8, 0.2), (1.8, 1.8), (0.2, 1.8)])
    assert "Aggregate" not in cells._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in cells.collect()) == [(0, 1), (1, 1)]


def crowd(spark, n=90, seed=4):
    """Points with ties of place and time, and their rows (id, days, x, y)."""
    rng = np.random.default_rng(seed)
    rows = [(int(d), float(x), float(y)) for d, x, y in zip(rng.integers(1, 20, n), rng.integers(-9, 9, n), rng.integers(-9, 9, n), strict=True)]
    pts = make_points(spark, [(f"2017-01-{d:02d}", x, y) for d, x, y in rows])
    return pts, [(k, float(d), x, y) for k, (d, x, y) in enumerate(rows)]


def column(rows, j, days, metres):
    """(i, d2, dt) of the events before j within both cut-offs."""
    _, t, x, y = rows[j]
    near = [(i, (a - x) ** 2 + (b - y) ** 2, t - s) for i, s, a, b in rows if (s, i) < (t, j)]
    return [(i, d2, dt) for i, d2, dt in near if d2 <= metres**2 and dt <= days]


@pytest.mark.parametrize("part", [3, 8192])
def test_columns_of_pairs_and_parents_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(knox, "PART", part)
    pts, rows = crowd(spark)
    want = {}
    for j in range(len(rows)):
        w = {i: math.exp(-dt / 0.1) * math.exp(-d2 / 5000) for i, d2, dt in column(rows, j, 4.0, 5.0)} | {j: 1.0}
        want |= {(i, j): v / sum(w.values()) for i, v in w.items()}
    p = sepp.initial_p(pts, 4.0, 5.0)
    assert {(r.i, r.j): r.p for r in p.collect()} == pytest.approx(want)
    assert {tuple(r) for r in sepp.initial_parents(pts, 4.0, 5.0, seed=3).collect()} == {tuple(r) for r in sepp.decluster(p, 3).collect()}
    # Nothing but events moves: no plan meets pairs by join, window or aggregate above the groups.
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("FlatMapGroupsInArrow") < plan.index("Join")


def test_histogram_fit_against_brute_force(spark):
    pts, rows = crowd(spark)
    grid, times, spaces = GridSpec(4.0, 4.0, -8.0, -8.0, 4, 4), [0.0, 1.0, 4.0], [0.0, 2.0, 5.0]
    pairs = {(i, j): (int(dt >= 1), int(d2 >= 4)) for j in range(len(rows)) for i, d2, dt in column(rows, j, 4 - 1e-9, 5 - 1e-9)}
    steps = {(i, j): math.exp(-dt / 0.1 - d2 / 5000) for j in range(len(rows)) for i, d2, dt in column(rows, j, 4 - 1e-9, 5 - 1e-9)}
    cell = {k: (int((x + 8) // 4), int((y + 8) // 4)) for k, _, x, y in rows if -8 <= x < 8 and -8 <= y < 8}
    own, off = dict.fromkeys(range(len(rows)), 1.0), steps
    for _ in range(3):
        total = dict(own)
        for (_, j), v in off.items():
            total[j] = total.get(j, 0.0) + v
        mu, g = {}, {}
        for k, c in cell.items():
            mu[c] = mu.get(c, 0.0) + own[k] / total[k] / (16 * 30)
        for (i, j), b in pairs.items():
            volume = (times[b[0] + 1] - times[b[0]]) * math.pi * (spaces[b[1] + 1] ** 2 - spaces[b[1]] ** 2)
            g[b] = g.get(b, 0.0) + off[i, j] / total[j] / volume / len(rows)
        own, off = {k: mu[c] for k, c in cell.items()}, {ij: g[b] for ij, b in pairs.items()}
        own |= dict.fromkeys(set(range(len(rows))) - set(cell), 0.0)
    p, background, trigger = sepp.histogram_fit(pts, grid, times, spaces, 30.0, 3)
    assert {(r.gx, r.gy): r.mu for r in background.collect()} == pytest.approx(mu)
    assert {(r.tb, r.sb): r.g for r in trigger.collect()} == pytest.approx(g)
    total = dict(own)
    for (_, j), v in off.items():
        total[j] += v
    want = {(k, k): own[k] / total[k] for k in cell} | {(i, j): v / total[j] for (i, j), v in off.items()}
    assert {(r.i, r.j): r.p for r in p.collect()} == pytest.approx(want)


def rates_model(time_reach):
    return sepp_kernels.Model(lambda t, x, y: F.lit(0.5) + t / 100, lambda dt, dx, dy: F.exp(-dt / 2 - (dx * dx + dy * dy) / 50), 4.0, time_reach)


@pytest.mark.parametrize("time_reach", [None, 3.0])
def test_rates_of_events_at_one_place_and_time(spark, time_reach):
    rows = [(float(t), float(x), float(y)) for t, x, y in np.random.default_rng(6).integers(0, 8, (80, 3))]
    events = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "event_id long, t double, x double, y double")
    model = rates_model(time_reach)

    def rate(t, x, y):
        near = [(t - s, (x - a) ** 2 + (y - b) ** 2) for s, a, b in rows]
        return 0.5 + t / 100 + sum(math.exp(-dt / 2 - d2 / 50) for dt, d2 in near if 0 < dt <= (time_reach or 99) and d2 <= 16)

    found = sepp_kernels.log_likelihood(model, events)
    assert found.head().likelihood == pytest.approx(sum(math.log(rate(*r)) for r in rows))
    # Pairs are summed where they meet: one join for them, one for their sums.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    places = spark.createDataFrame([(k, float(k), 3.0) for k in range(6)], "place_id long, px double, py double")
    times = [5.5, 6.5, 9.0]
    risks = sepp_kernels.range_predict(model, events, places, times)
    assert {r.place_id: r.risk for r in risks.collect()} == pytest.approx({k: sum(rate(t, k, 3.0) for t in times) / 3 for k in range(6)})
    assert risks._jdf.queryExecution().optimizedPlan().toString().count("EXP(") == 1


def test_fits_broadcast_no_written_tables(spark):
    pts, rows = crowd(spark)
    events = written(sepp_kernels.time_space(pts)[0])
    found = sepp_kernels.steps_within(pts, 4.0, 5.0)
    want = {(i, j): (dt, rows[j][2] - rows[i][2], rows[j][3] - rows[i][3]) for j in range(len(rows)) for i, _, dt in column(rows, j, 4.0, 5.0)}
    assert {(r.i, r.j): (r.dt, r.dx, r.dy) for r in found.collect()} == want
    steps = written(found)
    guess = written(sepp_kernels.first_guess(events, steps, 1.0, 60.0))
    mix = written(events.selectExpr("t as m0", "1D as v0", "0.1D as w"))
    for df in (guess, sepp_kernels.normalised(events, events.selectExpr("event_id", "1D as p"), guess), *sepp_kernels.drawn(events, steps, guess, 2), mixtures.density_at(mix, events, ["t"], ["event_id"])):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_events_at_one_place_of_a_street_weigh_together(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k, k + 1, 10.0) for k in range(6)], "edge_id long, k1 long, k2 long, length double")
    sizes = []

    def recorded(df):
        out = written(df)
        sizes[-1].append(out.count())
        return out

    monkeypatch.setattr(network, "written", recorded)
    risks = []
    for copies in (1, 4):
        sizes.append([])
        events = spark.createDataFrame([(k, k % 2 * 3, 0.25) for k in range(2 * copies)], "event_id long, edge_id long, t double")
        risks.append({r.edge_id: r.risk for r in network.network_hotspot_shortest(events, edges, 25.0).collect()})
    assert sizes[0] == sizes[1] and risks[1] == {k: 4 * v for k, v in risks[0].items()}


@pytest.mark.parametrize("dims,width,pairs", [(("x", "y"), 3, 1 << 20), (("x",), 1, 1 << 20), (("x", "y", "z"), 0, 7), (("x", "y", "z"), 2, 1 << 20)])
def test_neighbours_are_found_without_a_row_for_each_pair(spark, monkeypatch, dims, width, pairs):
    monkeypatch.setattr(hotspot, "WIDTH", width)
    monkeypatch.setattr(hotspot, "PAIRS", pairs)
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.normal(0, 1, (150, 3)), rng.integers(0, 3, (40, 3)) / 10.0, [[50.0, 0.0, 0.0]]])
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "event_id long, x double, y double, z double")
    found = hotspot.knn_distance(rows, 6, dims)
    d = np.sqrt(((at[:, None, : len(dims)] - at[None, :, : len(dims)]) ** 2).sum(axis=2))
    assert {r.event_id: r.distance for r in found.collect()} == pytest.approx(dict(enumerate(np.sort(d, axis=1)[:, 6])))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_leading_discs_are_the_rows_that_exceed_all_before(monkeypatch, small):
    """In one piece and in blocks, with events of one age, events of one place and weights."""
    monkeypatch.setattr(scan, "SMALL", small)
    for seed, k, weighted in ((0, 300, False), (1, 150, True), (2, 3, False), (3, 90, True)):
        rng = np.random.default_rng(seed)
        d2, age = rng.integers(0, 400, k) / 4.0, rng.integers(0, 200, k) / 8.0
        weight = rng.integers(1, 4, k) if weighted else np.ones(k, int)
        inside = np.sort(np.concatenate([np.repeat(d2, weight), rng.integers(0, 400, 5 * k) / 4.0]))
        n = 20 * k
        ages, at = np.unique(age, return_inverse=True)
        time_count = 3 * np.cumsum(np.bincount(at, weight)).astype(int)
        discs, best, want = np.unique(d2), 0.0, []
        for d in discs:
            held = np.array([int(weight[(d2 <= d) & (age <= a)].sum()) for a in ages])
            space = int((inside <= d).sum())
            if space > 0.4 * n:
                break
            value = scan.statistic(held.astype(float), space * time_count / n, n)
            c = int(value.argmax())
            if value[c] > best:
                best = float(value[c])
                want.append((float(d), float(ages[c]), space, int(time_count[c]), int(held[c]), best))
        got = scan.leading(d2, age, time_count[at], inside, n, 0.4, weight)
        assert [g[:5] for g in got] == [w[:5] for w in want] and [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-12)
        rows = scan.block_leads(np.array([[float(weight[(d2 <= d) & (age <= a)].sum()) for a in ages] for d in discs], np.float32), np.searchsorted(inside, discs, "right"), time_count, n, 0.0)
        assert [float(discs[r]) for r, *_ in rows][: len(want)] == [w[0] for w in want]


def test_tiles_count_the_pairs_of_blocks(spark):
    """Dense places on a lattice, whose distances meet the bins' edges, some of them at one time; many of the cells lie within a distance of one another."""
    rng = np.random.default_rng(6)
    rows = [(f"2024-01-{1 + k % 9:02d} {k % 24:02d}:00:00", float(a), float(b)) for k, (a, b) in enumerate(zip(rng.integers(-40, 60, 3000) / 2, rng.integers(-30, 50, 3000) / 2, strict=True))]
    pts = make_points(spark, rows + rows[:200])
    space, time = [(0.0, 5.0), (5.0, 10.0), (0.0, 10.0), (2.5, 7.5)], [(0, 0), (0, 86_400_000_000), (86_400_000_000, 2 * 86_400_000_000)]
    timed = pts.select("event_id", "x", "y", F.array(knox.micros("ts")).alias("times"))
    want = {(r.space_bin, r.time_bin): r.n for r in knox.bin_counts(timed, space, time).collect()}
    got = {(r.space_bin, r.time_bin): r.statistic for r in knox.knox_statistic(pts, space, time).collect()}
    assert got == want and len(want) == 12
