"""Cells that meet regions, paths between vertices, and studies, against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_golden import make_points
from test_regions import brute_inside, ring_table, star

from geopulse.functions.grid import GridSpec
from geopulse.operators import backtest, evaluate, graph, regions, sepp, study
from geopulse.plans import catalog


def brute_meets(box, rings):
    """Does a closed box share a place with the region? Some edge meets it, or its middle lies inside."""
    x0, y0, x1, y1 = box
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
            low, high = 0.0, 1.0
            for p, q, lo, hi in ((a, c, x0, x1), (b, d, y0, y1)):
                if p == q:
                    if not lo <= p <= hi:
                        low = 2.0
                else:
                    s, t = sorted(((lo - p) / (q - p), (hi - p) / (q - p)))
                    low, high = max(low, s), min(high, t)
            if (a, b) != (c, d) and low <= high:
                return True
    return brute_inside((x0 + x1) / 2, (y0 + y1) / 2, rings)


def test_cells_meeting_regions(spark):
    rng = np.random.default_rng(12)
    grid = GridSpec(3.0, 2.0, -15.0, -11.0, 10, 11)
    shapes = {k: [star(rng, x, y, r, 6), star(rng, x, y, r / 2, 4)] for k, (x, y, r) in enumerate([(0, 0, 9.0), (-14, 8, 4.0), (13, -9, 0.5), (3, 40, 2.0)])}
    shapes[9] = [[(6.0, 5.0), (9.0, 5.0), (9.0, 7.0), (6.0, 7.0)]]  # along the lattice: neighbours touch
    got = {tuple(r) for r in regions.cells_meeting(ring_table(spark, shapes), grid).collect()}
    assert got == {(i, j) for i in range(10) for j in range(11) if any(brute_meets(grid.cell_box(i, j), rings) for rings in shapes.values())}
    assert {(6 + i, 7 + j) for i in range(3) for j in range(3)} <= got
    over = regions.grid_over_regions(ring_table(spark, {9: shapes[9]}), grid)
    assert (over.xoffset, over.yoffset, over.xextent, over.yextent) == (6.0, 5.0, 2, 2)


def test_paths_between(spark):
    rng = np.random.default_rng(1)
    pairs = [p for p in itertools.combinations(range(7), 2) if rng.random() < 0.6]
    length = {p: float(v) for p, v in zip(pairs, rng.integers(1, 5, len(pairs)), strict=True)}
    edges = spark.createDataFrame([(i, *p, length[p]) for i, p in enumerate(pairs)], "edge_id long, k1 long, k2 long, length double")

    def brute(u, v, most, avoid):
        banned = {frozenset(p) for p in avoid}
        for n in range(6):
            for mid in itertools.permutations(set(range(7)) - {u, v}, n):
                path = [u, *mid, v]
                steps = [tuple(sorted(s)) for s in itertools.pairwise(path)]
                if all(s in length and frozenset(s) not in banned for s in steps) and sum(length[s] for s in steps) <= most:
                    yield tuple(path), sum(length[s] for s in steps)

    rows = lambda df: sorted((tuple(r.path), r.length) for r in df.collect())
    assert rows(graph.paths_between(edges, 0, 6)) == sorted(brute(0, 6, math.inf, [])) != []
    assert rows(graph.paths_between(edges, 0, 6, 8.0, [pairs[0], pairs[0][::-1], (90, 91)])) == sorted(brute(0, 6, 8.0, [pairs[0]]))
    assert rows(graph.paths_between(edges, 3, 3)) == [((3,), 0.0)] and rows(graph.paths_between(edges, 0, 77, 5.0)) == []
    one, two = pairs[0], pairs[-1]
    want = sorted(itertools.chain.from_iterable(brute(u, v, 9.0, [one, two]) if u != v else [((u,), 0.0)] for u in one for v in two))
    assert rows(graph.edge_paths_between(edges, one, two, 9.0)) == want


def test_study_scores_each_prediction(spark):
    rng = np.random.default_rng(2)
    rows = [(f"2017-01-{1 + int(d):02d}", float(x), float(y)) for d, x, y in zip(rng.integers(0, 28, 160), rng.normal(20, 9, 160), rng.normal(20, 9, 160), strict=True)]
    pts = make_points(spark, rows)
    grid = GridSpec(5.0, 5.0)
    rings = ring_table(spark, {1: [[(2.0, 3.0), (38.0, 1.0), (36.0, 39.0), (4.0, 33.0)], [(18.0, 18.0), (22.0, 18.0), (20.0, 22.0)]]})
    weeks = [("2017-01-15", "2017-01-22"), ("2017-01-22", "2017-01-29")]
    predictions = {"naive": ("naive", weeks), "scan": (study.scan_predictor(6.0, 10.0), weeks[1:]), "maximal": (study.scan_predictor(6.0, 10.0, maximal=True, sets=True), weeks[1:])}
    got = {(r.predictor, r.start, r.evaluator, r.key): r.value for r in study.study(pts, grid, predictions, rings=rings).collect()}
    assert len(got) == 4 * 8
    over = GridSpec(5.0, 5.0, 0.0, 0.0, 8, 8)
    shape = [[(2.0, 3.0), (38.0, 1.0), (36.0, 39.0), (4.0, 33.0)], [(18.0, 18.0), (22.0, 18.0), (20.0, 22.0)]]
    cells = {(i, j) for i in range(8) for j in range(8) if brute_meets(over.cell_box(i, j), shape)}
    inside = [(t, x, y) for t, x, y in rows if brute_inside(x, y, shape)]
    for start, end in weeks:
        surface = backtest.predict("naive", make_points(spark, inside), over, start, spark.createDataFrame(sorted(cells), "gx long, gy long"))
        scored = make_points(spark, [r for r in inside if start <= r[0] < end])
        assert got["naive", start, "likelihood", None] == pytest.approx(evaluate.log_likelihood(surface, scored, over).head().likelihood)
        assert got["naive", start, "brier", None] == pytest.approx(evaluate.brier(surface, scored, over).head().brier)
        rates = {r.coverage: r.rate for r in evaluate.hit_rates(surface, scored, over, [10, 50]).collect()}
        assert got["naive", start, "hit_rate", 10.0] == pytest.approx(rates[10]) and got["naive", start, "hit_rate", 50.0] == pytest.approx(rates[50])
        top = {(r.gx, r.gy) for r in surface.where("valid").collect()}
        assert top == cells


def test_study_scores_fits_the_whole_number_of_rounds(spark, monkeypatch):
    asked, rounds = {}, []
    monkeypatch.setattr(study, "study", lambda points, grid, predictions, **more: asked.update(predictions) or points.select(F.lit(1.0).alias("value")))
    monkeypatch.setattr(sepp, "em_step", lambda events, omega, theta, mu, *more, **named: rounds.append(omega) or (omega, theta, mu))
    catalog.study_scores(spark, "/root/testdata/sf0.001")
    predictor, _ = asked["sepp"]
    predictor(catalog.pts(spark, "/root/testdata/sf0.001"), catalog.GRID, "2024-01-22 00:00:00")
    assert len(rounds) == 20
