"""Small cases with known results."""

import math

import pytest
import simulate

from geopulse.functions.grid import GridSpec
from geopulse.operators import backtest, evaluate, graph, hotspot, knox, scan, sepp, surface
from geopulse.sources import tables


def make_points(spark, rows):
    """rows: (ts, x, y)."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, ts string, x double, y double")
    return df.withColumn("ts", df.ts.cast("timestamp_ntz"))


def risk_at(df):
    return {(r.gx, r.gy): r.risk for r in df.collect()}


def test_retro_grid_of_boxes(spark):
    pts = make_points(spark, [("2017-03-01", 0.0, 100.0), ("2017-03-02", 50.0, 120.0), ("2017-03-03", 50.0, 210.0)])
    grid = GridSpec.over_region((0.0, 100.0, 500.0, 500.0), 20)
    assert (grid.xextent, grid.yextent) == (25, 20)
    got = risk_at(hotspot.retro_grid(pts, grid, bandwidth=50.0))
    d2 = 10.0**2 + 10.0**2
    assert got[0, 0] == pytest.approx((1 - d2 / 2500) ** 2 + (1 - (40**2 + 10**2) / 2500) ** 2)
    assert got[20, 15] == 0


def test_prospective_grid(spark):
    pts = make_points(spark, [("2017-03-01 00:00:00", 50.0, 50.0)])
    grid = GridSpec(50.0, 50.0, 0.0, 0.0, 3, 3)
    week = 7 * 86_400_000_000
    for at, centre in (("2017-03-02", 1.0), ("2017-03-07", 1.0), ("2017-03-08", 0.5), ("2017-03-14", 0.5), ("2017-03-15", 1 / 3)):
        got = risk_at(hotspot.prospective_grid(pts, grid, at, week))
        assert got[1, 1] == pytest.approx(centre)
        assert got[0, 0] == got[2, 1] == pytest.approx(centre / 2)


def test_knox_counts(spark):
    pts = make_points(spark, [("2017-01-01 01:00:00", 1.0, 5.0), ("2017-01-01 02:00:00", 1.0, 7.0), ("2017-01-01 04:00:00", 1.0, 4.0)])
    hour = 3_600_000_000
    got = knox.knox_statistic(pts, [(0.9, 1.1), (0.9, 2.1), (1.5, 2.5)], [(0, 3 * hour), (2 * hour, 3 * hour)])
    assert {(r.space_bin, r.time_bin): r.statistic for r in got.collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 2, (1, 1): 1, (2, 0): 1, (2, 1): 0}


def test_scan_single_cluster(spark):
    pts = make_points(spark, [("2017-01-03", 0.0, 0.0), ("2017-01-02", 0.0, 0.0), ("2017-01-01", 1.0, 0.0)])
    found = scan.scan_candidates(pts, 2.0, 10.0, population_limit=1.0, time_limit=1.0)
    top = scan.clusters(found, pts).collect()
    assert [(r.cx, r.cy, r.radius, r.age) for r in top] == [(0.0, 0.0, 0.0, 1.0)]
    assert top[0].statistic == pytest.approx(0.3001045924)


def surface_of(spark, rows):
    return spark.createDataFrame([(x, y, float(v), v is not None) if v is not None else (x, y, 0.0, False) for y, row in enumerate(rows) for x, v in enumerate(row)], "gx long, gy long, risk double, valid boolean")


@pytest.mark.parametrize(
    "risks,fraction,chosen",
    [([1, 2, 3, 4, 5, 6], 0.7, {2, 3, 4, 5}), ([1, 1, 1, 2, 3, 4], 0.7, {2, 3, 4, 5}), ([2, 3, 4, 1, 1, 1], 0.7, {0, 1, 2, 5}), ([None, 2, 3, 0, None, 5], 0.5, {2, 5})],
)
def test_top_slice_ties(spark, risks, fraction, chosen):
    got = surface.slice_top(surface_of(spark, [risks]), fraction).where("selected").collect()
    assert {r.gx for r in got} == chosen


def test_hit_rates_one_event_for_each_cell(spark):
    grid = GridSpec(10.0, 20.0, 2.0, 3.0, 4, 2)
    s = surface_of(spark, [[1, 2, 3, 4], [5, 6, 7, 8]])
    pts = make_points(spark, [("2017-01-01", 2.0 + 10 * x + 5, 3.0 + 20 * y + 5) for x in range(4) for y in range(2)])
    got = {r.coverage: r.rate for r in evaluate.hit_rates(s, pts, grid, [100, 50, 49]).collect()}
    assert got == {100: 1.0, 50: 0.5, 49: 3 / 8}
    four = make_points(spark, [("2017-01-01", 2.0 + 10 * x + 5, 3.0 + 20 * y + 5) for x, y in ((0, 1), (1, 1), (3, 0), (3, 1))])
    got = {(r.hit_percent, r.coverage_percent) for r in evaluate.inverse_hit_rates(s, four, grid).collect()}
    assert got == {(25.0, 12.5), (50.0, 37.5), (75.0, 50.0), (100.0, 62.5)}


def test_masked_scores(spark):
    grid = GridSpec(10.0, 20.0, 2.0, 3.0, 4, 2)
    s = surface.renormalise(surface_of(spark, [[None, 2, 3, 4], [None, None, 7, None]]))
    pts = make_points(spark, [("2017-01-01", float(x), float(y)) for x, y in zip((12, 12, 22, 24, 24), (3, 3, 23, 5, 5), strict=True)])
    want = ((2 / 16 - 2 / 5) ** 2 + (3 / 16 - 2 / 5) ** 2 + (7 / 16 - 1 / 5) ** 2 + (4 / 16) ** 2) / (4 * 200)
    assert evaluate.brier(s, pts, grid).head().brier == pytest.approx(want)
    likelihood = evaluate.log_likelihood(s, pts, grid).head().likelihood
    assert likelihood == pytest.approx((2 * math.log(2 / 16) + math.log(7 / 16) + 2 * math.log(3 / 16)) / 5)


def test_dirichlet_score(spark):
    grid = GridSpec(1.0, 1.0, 0.0, 0.0, 2, 1)
    s = surface_of(spark, [[1, 2]])
    pts = make_points(spark, [("2017-01-01", 0.5, 0.5), ("2017-01-01", 0.5, 0.5), ("2017-01-01", 1.5, 0.5)])
    psi = lambda x: math.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4)
    want = math.log(300 * 301 * 302 / (100 * 101 * 200)) + psi(102) * 2 + psi(201) - 3 * psi(303)
    assert evaluate.bayes_dirichlet(s, pts, grid, bias=300).head().score == pytest.approx(want, abs=1e-6)


def test_sepp_columns_add_up(spark):
    pts = make_points(spark, [("2017-01-01 00:00:00", 5.0, 5.0), ("2017-01-01 02:00:00", 5.0, 6.0), ("2017-01-01 05:00:00", 55.0, 5.0)])
    p = sepp.initial_p(pts, 1.0, 10.0)
    assert {r.j: round(r.s, 9) for r in p.groupBy("j").agg({"p": "sum"}).withColumnRenamed("sum(p)", "s").collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    omega, theta, mu = sepp.train_grid(pts, GridSpec(50.0, 50.0, 0.0, 0.0, 2, 1), iterations=2)
    assert omega > 0 and 0 < theta < 1 and mu.count() == 2


def test_components_and_segments(spark):
    edges = spark.createDataFrame([(1, 10, 11, 1.0), (2, 11, 12, 1.0), (3, 12, 13, 1.0), (4, 12, 14, 1.0), (5, 20, 21, 1.0)], "edge_id long, k1 long, k2 long, length double")
    assert {r.key: r.component for r in graph.connected_components(edges).collect()} == {10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 20: 20, 21: 20}
    assert {r.edge_id: r.segment for r in graph.segments(edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {r.key: r.distance for r in graph.shortest_paths(edges, 10).collect()} == {10: 0.0, 11: 1.0, 12: 2.0, 13: 3.0, 14: 3.0, 20: -1.0, 21: -1.0}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "case, PRIMARY DESCRIPTION,DATE  OF OCCURRENCE,X COORDINATE,Y COORDINATE\n1,THEFT,01/01/2017 10:30:23 PM,789,1012\n2,ASSAULT,01/01/2017 10:30:23 PM,1,2\n3,THEFT ,03/13/2016 02:53:30 AM,123,456\n4,THEFT,03/13/2016 02:53:30 AM,,456\n"
    )
    got = sorted(tables.csv_events(spark, str(tmp_path / "a.csv"), {"THEFT"}).collect())
    assert [str(r.ts) for r in got] == ["2016-03-13 02:53:30", "2017-01-01 22:30:23"]
    assert got[0].x == pytest.approx(123 * 1200 / 3937)
    (tmp_path / "b.csv").write_text("Month,Longitude,Latitude,Crime type\n2017-01,1.5,53,A\n2016-03,1.6,54,B\n")
    assert sorted(str(r.ts)[:7] for r in tables.monthly_csv(spark, str(tmp_path / "b.csv"), set()).collect()) == ["2016-03", "2017-01"]
    events, problems = tables.configured_csv(spark, str(tmp_path / "a.csv"), 2, 3, 4, "MM/dd/yyyy hh:mm:ss a")
    assert events.count() == 3 and {r.problem: r.n for r in problems.collect()} == {"empty": 1}


def test_hit_count_files(spark, tmp_path):
    pts = make_points(spark, [(f"2017-01-{d:02d} 05:00:00", 10.0 * (d % 3) + 5, 5.0) for d in range(1, 22)])
    results = backtest.backtest(pts, GridSpec(10.0, 10.0, 0.0, 0.0, 3, 1), ["naive"], backtest.periods("2017-01-08", "2017-01-22", 7), [34, 100])
    backtest.write_hit_counts(results, str(tmp_path / "hits"), [34, 100])
    back = backtest.read_hit_counts(spark, str(tmp_path / "hits"), [34, 100])
    key = lambda r: (r.start, r.coverage, r.hits, r.total)
    assert sorted(map(key, back.collect())) == sorted(map(key, results.collect()))


def test_simulation_repeats(spark):
    one = simulate.random_uniform(spark, (0.0, 0.0, 10.0, 20.0), "2020-01-01 00:00:00", 1000.0, 200, seed=3)
    rows = one.collect()
    assert rows == simulate.random_uniform(spark, (0.0, 0.0, 10.0, 20.0), "2020-01-01 00:00:00", 1000.0, 200, seed=3).collect()
    assert all(0 <= r.x < 10 and 0 <= r.y < 20 for r in rows)


def test_prediction_keys():
    assert evaluate.parse_prediction_key("Retro(weight=Quartic(bandwidth=200), days=60, scale=0.5)") == ("Retro", {"weight": "Quartic(bandwidth=200)", "days": 60, "scale": 0.5})
    assert evaluate.parse_prediction_key("Naive") == ("Naive", {})


def test_prediction_dates():
    got = backtest.prediction_dates("2017-01-01 10:00:00", "2017-01-04 00:00:00", 1, 1)
    assert got == [(f"2017-01-0{d} 00:00:00", f"2017-01-0{d + 1} 00:00:00") for d in (1, 2, 3)]


def test_lines_to_graph_and_back(spark, tmp_path):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0), (1, 2, 5.1, 1.2), (2, 0, 2.0, 0.0), (2, 1, 1.001, 1.0), (2, 2, 0.0, 5.0), (2, 3, 5.1, 1.2), (3, 0, 0.0, 0.0), (3, 1, 0.0, 5.0)]
    vertices, edges = graph.from_lines(spark.createDataFrame(rows, "line_id long, seq int, x double, y double"), 0.1)
    assert vertices.count() == 5 and edges.count() == 6
    graph.write_graph(vertices, edges, str(tmp_path / "g"))
    v, e = graph.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(str, v.collect())) == sorted(map(str, vertices.collect())) and e.count() == 6
    reduced = graph.reduce_chains(edges)
    assert reduced.agg({"length": "sum"}).head()[0] == pytest.approx(edges.agg({"length": "sum"}).head()[0])


def test_network_risk_of_one_event(spark):
    from geopulse.operators import network

    edges = spark.createDataFrame([(1, 0, 1, 4.0), (2, 1, 2, 4.0), (3, 1, 3, 4.0)], "edge_id long, k1 long, k2 long, length double")
    events = spark.createDataFrame([(7, 1, 0.75)], "event_id long, edge_id long, t double")
    want = {1: ((1 / 5 + 4 / 25) / 2 + (1 / 5 + 2 / 25) * 3 / 2) / 4, 2: (16 / 50) / 2 / 4, 3: (16 / 50) / 2 / 4}
    for fn in (network.network_hotspot, network.network_hotspot_shortest):
        got = {r.edge_id: r.risk for r in fn(events, edges, 5.0).collect()}
        assert got == pytest.approx(want)
    covered = network.coverage(spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "edge_id long, risk double"), edges, 0.5)
    assert [r.edge_id for r in covered.collect()] == [1]
    crossing = network.coverage(spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "edge_id long, risk double"), edges, 0.5, crossing=True)
    assert sorted(r.edge_id for r in crossing.collect()) == [1, 2]


def test_stream_counts(spark, tmp_path):
    from geopulse.streaming.counts import windowed_cell_counts

    pts = make_points(spark, [("2017-01-01 05:00:00", 5.0, 5.0), ("2017-01-01 06:00:00", 5.0, 6.0), ("2017-01-03 05:00:00", 15.0, 5.0)])
    pts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    query = windowed_cell_counts(stream, GridSpec(10.0, 10.0, 0.0, 0.0, 2, 1)).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    try:
        query.processAllAvailable()
        assert {(r.gx, r["count"]) for r in spark.table("cells").collect()} == {(0, 2), (1, 1)}
    finally:
        query.stop()


def test_beta_posterior_of_large_counts(spark):
    counts = spark.createDataFrame([(1, 3_000_000_000, 8_000_000_000), (1, 1_000_000_000, 2_000_000_000)], "coverage int, hits long, total long")
    row = evaluate.beta_posterior(counts, ["coverage"]).head()
    a, b = 4e9, 6e9
    assert (row.a, row.b, row.mean) == (4_000_000_000, 6_000_000_000, 0.4)
    assert row.sd == pytest.approx((a * b / (1e10 * 1e10 * (1e10 + 1))) ** 0.5)
