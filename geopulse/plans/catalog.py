"""Registry of the named queries over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.functions.grid import GridSpec
from geopulse.functions.tables import written
from geopulse.operators import backtest as bt
from geopulse.operators import correlated, evaluate, geometry, graph, hotspot, kernels_nd, knox, network, points, regions, scan, scan_sets, sepp, sepp_kernels, study, surface

GRID = GridSpec(150.0, 150.0, 0.0, 0.0, 33, 20)
TRAIN_END, SCORE_END = "2024-01-22 00:00:00", "2024-01-29 00:00:00"
COVERAGES = [1, 5, 10, 20, 50]
POLYGON = [(310.0, 205.0), (2905.0, 410.0), (2505.0, 2610.0), (1105.0, 2210.0)]
SEGMENTS = [(1, 100.0, 120.0, 940.0, 610.0), (2, 1000.0, 330.0, 1000.0, 990.0), (3, 2000.0, 1210.0, 1430.0, 1210.0), (4, 505.0, 2405.0, 1210.0, 1705.0)]
DAY = 86_400_000_000
SPACE_BINS = [(0.0, 50.0), (50.0, 100.0), (0.0, 100.0)]
TIME_BINS = [(0, DAY), (DAY, 3 * DAY), (0, 7 * DAY)]

EVERY_COVERAGE = list(range(1, 101))

Query = Callable[[SparkSession, str], DataFrame]


def pts(spark: SparkSession, sf: str) -> DataFrame:
    return points.load_points(spark, sf)


def train(spark: SparkSession, sf: str) -> DataFrame:
    return points.between(pts(spark, sf), end=TRAIN_END)


def score(spark: SparkSession, sf: str) -> DataFrame:
    """The events of the scored week on the grid."""
    p = points.between(pts(spark, sf), TRAIN_END, SCORE_END)
    return p.where(GRID.inside(GRID.gx(), GRID.gy()))


def base(spark: SparkSession, sf: str) -> DataFrame:
    """The training events' counts plus 1 as a surface."""
    return hotspot.count_grid(train(spark, sf), GRID).withColumn("risk", F.col("risk") + 1)


def prob(spark: SparkSession, sf: str) -> DataFrame:
    return surface.renormalise(base(spark, sf))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def risks(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select("gx", "gy", F.round("risk", places).alias("risk"))


def with_days(spark: SparkSession, sf: str) -> DataFrame:
    """The training events with their time t in days since the year's begin."""
    return train(spark, sf).withColumn("t", (points.micros("ts") - points.micros(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))) / DAY)


def density(df: DataFrame, places: int) -> DataFrame:
    return rounded(df, "density", places=places).where("density > 0")


def waves(x: Column, y: Column) -> Column:
    """A kernel of places for the predictions from kernels."""
    return (1 + F.sin(x / 300)) * F.exp(-y / 2000)


def occupied(spark: SparkSession, sf: str) -> DataFrame:
    """The grid's cells that hold events, with the number n of events."""
    return GRID.with_cells(pts(spark, sf)).where(GRID.inside()).groupBy("gx", "gy").agg(F.count("*").alias("n"))


def streets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Streets where events are: each cell with events is a vertex (key = 100 gy + gx) at its corner, and neighbouring ones are joined,
    unless their events together are a multiple of 5, so that vertices of every degree occur. Written, as graphs are read in many rounds."""
    cells = written(occupied(spark, sf))
    other = cells.select(F.col("gx").alias("ux"), F.col("gy").alias("uy"), F.col("n").alias("m"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (0, 1))))
    near = cells.select("*", F.explode(steps).alias("s")).join(other, F.expr("ux = gx + s.a and uy = gy + s.b")).where("(n + m) % 5 <> 0")
    key = lambda x, y: 100 * F.col(y) + F.col(x)
    edges = near.select((2 * key("gx", "gy") + F.col("s.b")).alias("edge_id"), key("gx", "gy").alias("k1"), key("ux", "uy").alias("k2"), F.lit(150.0).alias("length"))
    return cells.select(key("gx", "gy").alias("key"), (F.col("gx") * 150.0).alias("x"), (F.col("gy") * 150.0).alias("y")), written(edges)


def an_edge(edges: DataFrame) -> tuple[int, int, int]:
    """(edge_id, k1, k2) of the first street along x from 604 on."""
    return tuple(edges.where("edge_id >= 604 and edge_id % 2 = 0").orderBy("edge_id").select("edge_id", "k1", "k2").head())


def on_streets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices and edges of the streets, and all events near one of them (event_id, edge_id, t)."""
    vertices, edges = streets(spark, sf)
    return vertices, edges, written(network.network_points(pts(spark, sf), vertices, edges, 75.0))


def masked(spark: SparkSession, sf: str) -> DataFrame:
    """The base surface, valid where the training events are."""
    return surface.mask_with(base(spark, sf), geometry.mask_by_points(train(spark, sf), GRID))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["hotspot_backtest"] = lambda s, d: bt.naive_backtest(pts(s, d), GRID, bt.periods("2024-01-08", SCORE_END, 7), COVERAGES)
    # Points.
    q["points_events_before"] = lambda s, d: points.events_before(pts(s, d), "2024-01-10 12:00:00").select("event_id", "x", "y")
    q["points_bbox"] = lambda s, d: points.bounding_box(pts(s, d))
    q["points_time_deltas"] = lambda s, d: points.time_deltas(pts(s, d))
    q["points_bin_timestamps"] = lambda s, d: points.bin_timestamps(pts(s, d), "2024-01-05 06:00:00", DAY).groupBy("ts").agg(F.count("*").alias("n"))
    q["points_type_counts"] = lambda s, d: points.counts_by_type(pts(s, d))
    q["points_train"] = lambda s, d: points.training(pts(s, d), "2024-01-03 00:00:00", TRAIN_END, ["click", "error"]).select("event_id")
    q["points_assess"] = lambda s, d: points.assessment(pts(s, d), TRAIN_END, SCORE_END, ["click", "error"]).select("event_id")
    q["points_default_split"] = lambda s, d: points.default_split(pts(s, d))
    q["project_lonlat"] = lambda s, d: rounded(points.project_lonlat(points.translate(pts(s, d).withColumns({"x": F.col("x") / 1e5, "y": F.col("y") / 1e5}), -1.5, 51.0)), "x", "y", places=3).select("event_id", "x", "y")
    q["points_split_counts"] = lambda s, d: points.split_counts(pts(s, d), "2024-01-03 00:00:00", TRAIN_END, TRAIN_END, SCORE_END)
    # Grids and geometry.
    q["grid_over_points"] = lambda s, d: (lambda g: g.cells(s).select((F.col("gx") * g.xsize + g.xoffset).alias("x"), (F.col("gy") * g.ysize + g.yoffset).alias("y")))(geometry.grid_over_points(pts(s, d), GridSpec(130.0, 170.0, 35.0, -20.0)))
    q["points_in_regions"] = lambda s, d: regions.places_in_regions(pts(s, d), event_rings(s, d), ["event_id"])
    q["cells_meeting_regions"] = lambda s, d: regions.cells_meeting(event_rings(s, d), GRID)
    q["region_edge_factors"] = lambda s, d: rounded(correlated.region_factors(pts(s, d), cell_centres(occupied(s, d)), ["gx", "gy"], event_rings(s, d)), "factor")
    q["grid_coord"] = lambda s, d: GRID.with_cells(pts(s, d)).select("event_id", "gx", "gy")
    q["grid_snap_centre"] = lambda s, d: geometry.snap_to_centres(pts(s, d), 250.0, 20.0, 30.0).select("event_id", "x", "y")
    q["grid_mask_points"] = lambda s, d: geometry.mask_by_points(pts(s, d), GRID)
    q["grid_mask_polygon"] = lambda s, d: geometry.mask_by_polygon(occupied(s, d).select("gx", "gy"), GRID, POLYGON)
    q["points_in_polygon"] = lambda s, d: geometry.points_in_polygon(pts(s, d), POLYGON).select("event_id")
    q["segment_grid_split"] = lambda s, d: rounded(geometry.segment_cells(network.edge_segments(*shifted(*streets(s, d))), GRID), "t1", "t2")
    q["project_point_to_segments"] = lambda s, d: rounded(geometry.project(pts(s, d), s.createDataFrame(SEGMENTS, "segment_id long, x1 double, y1 double, x2 double, y2 double"), 300.0), "t", "distance")
    # Predictors.
    q["naive_count_grid"] = lambda s, d: risks(hotspot.count_grid(train(s, d), GRID))
    q["retro_grid_quartic"] = lambda s, d: risks(hotspot.retro_grid(train(s, d), GRID))
    q["retro_grid_gauss"] = lambda s, d: risks(hotspot.retro_grid(train(s, d), GRID, hotspot.kernels.truncated_gaussian, 300.0))
    q["retro_cts_subgrid"] = lambda s, d: risks(hotspot.retro_subgrid(train(s, d), GRID, 2))
    for kind in ("same", "diff", "circle"):
        q[f"prospective_grid_{kind}"] = lambda s, d, kind=kind: risks(hotspot.prospective_grid(train(s, d), GRID, TRAIN_END, DAY, kind))
    q["prospective_cts_subgrid"] = lambda s, d: risks(hotspot.prospective_subgrid(train(s, d), GRID, TRAIN_END, DAY, 2, 3.0, 8.0))
    q["kde_gaussian_scott"] = lambda s, d: risks(hotspot.gaussian_kde(train(s, d), GRID), 12)
    q["kde_fixed"] = lambda s, d: risks(hotspot.gaussian_kde(train(s, d), GRID, 120.0), 12)
    q["kde_time_exp"] = lambda s, d: risks(hotspot.time_weighted_kde(train(s, d), GRID, TRAIN_END, DAY, "exp", 5.0, 200.0), 12)
    q["kde_time_quad"] = lambda s, d: risks(hotspot.time_weighted_kde(train(s, d), GRID, TRAIN_END, DAY, "quad", 5.0), 12)
    q["kde_knn"] = lambda s, d: risks(hotspot.nearest_neighbour_kde(train(s, d), GRID, 15), 12)
    q["kde_edge_corrected"] = lambda s, d: risks(hotspot.edge_corrected_kde(train(s, d), masked(s, d), GRID, 200.0), 12)
    q["kde_score"] = lambda s, d: rounded(evaluate.kde_score(surface.renormalise(masked(s, d)), score(s, d), GRID, 300.0), "score")
    q["kde_score_scott"] = lambda s, d: rounded(correlated.score(surface.renormalise(masked(s, d)), score(s, d), GRID), "score")
    q["kde_correlated_3d"] = kde_correlated
    q["knn_distance"] = lambda s, d: rounded(hotspot.knn_distance(pts(s, d), 15), "distance")
    q["kde_mixture_3d"] = lambda s, d: density(kernels_nd.on_lattice(kernels_nd.mixture(with_days(s, d), ["t", "x", "y"], 15), [(3.0, 6.0, 4), (400.0, 700.0, 5), (300.0, 500.0, 5)]), 15)
    q["kde_mixture_marginal"] = lambda s, d: density(kernels_nd.on_lattice(kernels_nd.marginal(kernels_nd.mixture(with_days(s, d), ["t", "x", "y"], 15), 1), [(0.0, 250.0, 16)]), 12)
    q["kde_reflected_time"] = lambda s, d: density(kernels_nd.on_lattice(kernels_nd.reflected(kernels_nd.mixture(with_days(s, d), ["t"], 100)), [(0.0, 0.5, 40)]), 9)
    q["prediction_from_kernel"] = lambda s, d: risks(kernels_nd.from_kernel(occupied(s, d).select("gx", "gy"), GRID, waves, 4), 9)
    q["prediction_masked"] = lambda s, d: risks(kernels_nd.from_kernel(masked(s, d).where("valid"), GRID, waves, 3), 9)
    q["grid_mask_area"] = lambda s, d: geometry.cells_by_area(occupied(s, d).select("gx", "gy"), GRID, POLYGON)
    q["segments_meeting_polygon"] = lambda s, d: geometry.segments_meeting(network.edge_segments(*streets(s, d)), POLYGON).select("segment_id")
    q["surface_cropped"] = lambda s, d: geometry.crop_surface(base(s, d), GRID, POLYGON).select("gx", "gy", "risk", "valid")
    # Surfaces.
    q["surface_renormalise"] = lambda s, d: risks(prob(s, d), 9)
    q["surface_percentile"] = lambda s, d: rounded(surface.percentile(base(s, d)), "percentile")
    q["surface_new_extent"] = lambda s, d: risks(surface.new_extent(base(s, d), GRID, GRID.moved(-300.0, 450.0, 30, 22)))
    q["surface_mask"] = lambda s, d: surface.mask_with(base(s, d), geometry.mask_by_points(points.between(pts(s, d), TRAIN_END, SCORE_END), GRID)).select("gx", "gy", "risk", "valid")
    q["surface_zero_to_constant"] = lambda s, d: risks(surface.zero_to_constant(hotspot.count_grid(pts(s, d).where("category = 'error'"), GRID)))
    # Scores.
    q["top_slice"] = lambda s, d: surface.slice_top(base(s, d), 0.1).where("selected").select("gx", "gy", "risk")
    q["hit_counts"] = lambda s, d: evaluate.hit_counts(base(s, d), points.between(pts(s, d), TRAIN_END, SCORE_END), GRID, COVERAGES)
    q["hit_rate"] = lambda s, d: rounded(evaluate.hit_rates(base(s, d), points.between(pts(s, d), TRAIN_END, SCORE_END), GRID, COVERAGES), "rate")
    q["max_hit_rate"] = lambda s, d: rounded(evaluate.maximum_hit_rates(GRID, score(s, d), COVERAGES), "rate")
    q["inverse_hit_rate"] = lambda s, d: rounded(evaluate.inverse_hit_rates(base(s, d), score(s, d), GRID), "hit_percent", "coverage_percent")
    q["likelihood"] = lambda s, d: rounded(evaluate.log_likelihood(prob(s, d), score(s, d), GRID), "likelihood")
    q["brier"] = lambda s, d: rounded(evaluate.brier(prob(s, d), score(s, d), GRID), "brier", "skill", places=12)
    q["kl"] = lambda s, d: rounded(evaluate.kl(prob(s, d), score(s, d), GRID), "kl", places=12)
    q["multiscale_brier"] = lambda s, d: rounded(evaluate.multiscale_brier(prob(s, d), score(s, d), GRID, 3), "brier", "skill", places=12)
    q["multiscale_kl"] = lambda s, d: rounded(evaluate.multiscale_kl(prob(s, d), score(s, d), GRID, 3), "kl", places=12)
    q["ranking"] = lambda s, d: rounded(evaluate.ranking(prob(s, d), score(s, d), GRID), "percentile")
    q["bayes_predictive"] = lambda s, d: rounded(evaluate.bayes_predictive(prob(s, d), score(s, d), GRID), "score")
    q["bayes_dirichlet"] = lambda s, d: rounded(evaluate.bayes_dirichlet(prob(s, d), score(s, d), GRID), "score", places=4)
    q["poisson_crps"] = lambda s, d: rounded(evaluate.poisson_crps(prob(s, d), score(s, d), GRID), "crps", places=3)
    q["beta_posterior"] = lambda s, d: rounded(evaluate.beta_posterior(q["hotspot_backtest"](s, d), ["coverage"]), "mean", "sd")
    # Interaction and clusters.
    q["knox_statistic"] = lambda s, d: knox.knox_statistic(pts(s, d), SPACE_BINS, TIME_BINS)
    q["knox_pvalue"] = lambda s, d: knox.knox_pvalues(pts(s, d), SPACE_BINS, TIME_BINS, 99).drop("distribution")
    q["scan_best_per_centre"] = lambda s, d: rounded(scan.best_per_centre(scan.leading_candidates(pts(s, d), 300.0, 3.0)), "d2", "statistic").select("centre", "d2", "statistic", "space_count", "actual")
    q["scan_clusters"] = lambda s, d: scan.clusters(scan.leading_candidates(pts(s, d), 300.0, 3.0, each=False), pts(s, d))
    q["scan_maximal"] = lambda s, d: rounded(scan.maximal(small_clusters(s, d), scan.with_age(pts(s, d), None, DAY)), "radius", "statistic").select("rank", "centre", "radius", "statistic")
    q["scan_surface"] = lambda s, d: risks(scan.scan_surface(small_clusters(s, d), GRID.cells(s), GRID), 9)
    q["scan_continuous"] = lambda s, d: rounded(scan.continuous_risk(small_clusters(s, d), pts(s, d).select(F.col("event_id").alias("place_id"), "x", "y")), "risk").select("place_id", "risk")
    q["scan_set_clusters"] = lambda s, d: rounded(scan.clusters(scan_sets.leading_sets(pts(s, d), 60.0, 2.0), pts(s, d)), "radius", "statistic").select("rank", "centre", "radius", "statistic")
    q["scan_tied_discs"] = lambda s, d: rounded(scan_sets.set_candidates(geometry.snap_to_centres(pts(s, d), 50.0), 75.0, 3.0, ties=True), "d2", "statistic")
    # Self-exciting processes.
    q["seppexp_p_matrix"] = lambda s, d: rounded(sepp.p_matrix_columns(*sepp_columns(s, d)), "background", "triggered")
    q["seppexp_em_1"] = sepp_em
    q["seppexp_predict"] = sepp_predict
    q["seppexp_em_corrected"] = lambda s, d: sepp_em(s, d, corrected=True)
    q["sepp_initial_p"] = lambda s, d: rounded(sepp.initial_p(pts(s, d), 2.0, 100.0), "p")
    q["sepp_decluster"] = lambda s, d: sepp.initial_parents(pts(s, d), 2.0, 100.0, seed=5)
    q["sepp_declustered"] = sepp_declustered
    q["sepp_fitted_predict"] = sepp_fitted_predict
    q["sepp_background_predict"] = lambda s, d: sepp_surface(sepp_kernels.background_predict(SEPP_MODEL, sepp_places(s), SEPP_AT), 9)
    q["sepp_point_predict"] = lambda s, d: sepp_surface(sepp_kernels.point_predict(SEPP_MODEL, sepp_events(s, d), sepp_places(s), SEPP_AT), 9)
    q["sepp_range_predict"] = lambda s, d: sepp_surface(sepp_kernels.range_predict(SEPP_MODEL, sepp_events(s, d), sepp_places(s), sepp_kernels.times_between(SEPP_AT, SEPP_AT + 7, 20)), 9)
    q["sepp_separable_predict"] = lambda s, d: sepp_surface(sepp_kernels.separable_predict(SEPP_SEPARABLE, sepp_events(s, d), sepp_places(s), sepp_kernels.times_between(SEPP_AT, SEPP_AT + 7, 5)), 9)
    q["sepp_tabulated_predict"] = sepp_tabulated
    q["sepp_log_likelihood"] = lambda s, d: rounded(sepp_kernels.log_likelihood(SEPP_MODEL, sepp_events(s, d)), "likelihood", places=3)
    q["sepp_grid_predict"] = lambda s, d: risks(sepp_kernels.on_grid(sepp_kernels.point_predict(SEPP_MODEL, sepp_events(s, d), sepp_places(s), SEPP_AT), GRID, 2, masked(s, d).where("valid")).where("valid"), 9)
    # Graphs and networks.
    q["graph_degree"] = lambda s, d: graph.degrees(streets(s, d)[1])
    q["graph_derived"] = lambda s, d: graph.derived_graph(streets(s, d)[1])
    q["graph_components"] = lambda s, d: graph.connected_components(streets(s, d)[1].where("edge_id % 3 <> 1"))
    q["graph_shortest_paths"] = lambda s, d: from_an_edge(s, d, lambda e, _, a, b: graph.shortest_paths(e, b).select("key", "distance"))
    q["graph_simple_paths"] = lambda s, d: from_an_edge(s, d, lambda e, _, a, b: graph.simple_paths(e, b, 750.0, 5).select(F.concat_ws(",", F.transform("path", lambda k: k.cast("string"))).alias("path"), "length"))
    q["graph_paths_between"] = lambda s, d: from_an_edge(s, d, lambda e, _, a, b: graph.paths_between(e, a, b, 900.0, [(a, b)]).select(F.concat_ws(",", F.transform("path", lambda k: k.cast("string"))).alias("path"), "length"))
    q["graph_walk_degrees"] = lambda s, d: from_an_edge(s, d, lambda e, _, a, b: graph.walks_with_degrees(e, b, a, 600.0, 50.0))
    q["graph_segments"] = lambda s, d: graph.segments(streets(s, d)[1])
    q["graph_ordered_segments"] = lambda s, d: graph.ordered_segments(streets(s, d)[1])
    q["graph_from_lines"] = from_lines
    q["graph_from_paths"] = lambda s, d: rounded(graph.from_paths(ways(s, geometry.snap_to_centres(pts(s, d), 250.0), d))[1], "length")
    q["network_hotspot_indexed"] = lambda s, d: rounded((lambda v, e, p: network.network_hotspot_indexed(p, e, network.path_index(e, 400.0), 320.0))(*on_streets(s, d)), "risk")
    q["graph_split_edges"] = lambda s, d: graph.split_edges(*streets(s, d), 60.0)
    q["network_project"] = lambda s, d: rounded(on_streets(s, d)[2], "t")
    q["network_hotspot"] = lambda s, d: rounded((lambda v, e, p: network.network_hotspot(p, e, 320.0))(*on_streets(s, d)), "risk")
    q["network_approx"] = lambda s, d: rounded((lambda v, e, p: network.network_hotspot_shortest(p, e, 320.0))(*on_streets(s, d)), "risk")
    q["network_hit_counts"] = lambda s, d: rounded((lambda v, e, p: network.hit_counts_by_coverage(p, edge_counts(e, p), e, [10, 20, 50]))(*on_streets(s, d)), "rate")
    q["grid_coverage_to_graph"] = lambda s, d: network.covered_edges(surface.slice_top(base(s, d), 0.1).where("selected"), GRID, *shifted(*streets(s, d)), 0.5)
    q["graph_reduced"] = lambda s, d: graph.reduce_chains(streets(s, d)[1]).select("k1", "k2", "length")
    q["sepp_histogram_fit"] = lambda s, d: sepp.histogram_fit(pts(s, d), GRID, [0.0, 0.5, 1.0, 2.0], [0.0, 50.0, 100.0], 30.0, 2)[2]
    q["network_coverage"] = lambda s, d: (lambda v, e, p: network.coverage(edge_counts(e, p), e, 0.2))(*on_streets(s, d))
    q["network_hit_rate"] = lambda s, d: rounded((lambda v, e, p: network.network_hit_rate(p, network.coverage(edge_counts(e, p), e, 0.2)))(*on_streets(s, d)), "rate")
    q["grid_risk_to_graph"] = lambda s, d: network.grid_risk_to_edges(base(s, d), GRID, *shifted(*streets(s, d)))
    q["graph_edge_paths"] = lambda s, d: from_an_edge(s, d, lambda e, k, *_: graph.shortest_edge_paths(e, k, 0.25).select("key", "distance"))
    q["graph_edge_distances"] = lambda s, d: from_an_edge(s, d, lambda e, k, *_: graph.edge_distances(e, k))
    q["network_places"] = lambda s, d: rounded(graph.edge_places(*on_streets(s, d)), "t", "x", "y").select("event_id", "x", "y")
    q["grid_risk_subdivided"] = lambda s, d: rounded(network.grid_risk_subdivided(base(s, d), GRID, *shifted(*streets(s, d))), "x1", "y1", "x2", "y2", "length")
    # Back-tests.
    q["backtest_rates"] = lambda s, d: bt.wide(rounded(bt.backtest(pts(s, d), GRID, ["naive"], bt.periods("2024-01-15", SCORE_END, 7), EVERY_COVERAGE), "rate"), "rate", EVERY_COVERAGE).drop("total")
    q["backtest_pivot"] = lambda s, d: bt.wide(q["hotspot_backtest"](s, d).withColumn("predictor", F.lit("naive")), "hits", COVERAGES)
    q["backtest_predictors"] = lambda s, d: rounded(bt.backtest(pts(s, d), GRID, ["naive", "retro", "prospective"], bt.periods("2024-01-15", SCORE_END, 7), [10, 20]), "rate")
    q["study_scores"] = study_scores
    return q


def study_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Predictors of several kinds over the regions of events; the cell grid's predictors for two weeks, clusters for the last."""
    weeks = bt.periods("2024-01-15", SCORE_END, 7)
    predictions = {"naive": ("naive", weeks), "retro": ("retro", weeks), "sepp": (study.sepp_predictor(), weeks[1:]), "scan": (study.scan_predictor(60.0, 2.0), weeks[1:])}
    return rounded(study.study(pts(spark, sf), GRID, predictions, rings=event_rings(spark, sf)), "value")


def small_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters within 60 m and two days of the last event."""
    return written(scan.clusters(scan.leading_candidates(pts(spark, sf), 60.0, 2.0, each=False), pts(spark, sf)))


def ways(spark: SparkSession, places: DataFrame, sf: str) -> DataFrame:
    """Each user's way through the places of their events as a line."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts").join(places.select("event_id", "x", "y"), "event_id")
    return steps.select(F.col("user_id").alias("line_id"), F.row_number().over(w).alias("seq"), "x", "y")


def from_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The vertices of each user's way through their events, where places of up to 40 m are one vertex."""
    return graph.from_lines(ways(spark, pts(spark, sf), sf), 40.0)[0].select("x", "y")


def event_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of events: in each cell of 750 m the events farthest to the left, below, to the right and above are the corners of a ring;
    half way from them to their mean are the corners of a hole."""
    cells = GridSpec(750.0, 750.0).with_cells(pts(spark, sf)).groupBy("gx", "gy")
    across, along = F.struct("x", "event_id", "y"), F.struct("y", "event_id", "x")
    c = cells.agg(F.min(across).alias("c0"), F.min(along).alias("c1"), F.max(across).alias("c2"), F.max(along).alias("c3"))
    c = c.withColumns({f"m{v}": (F.col(f"c0.{v}") + F.col(f"c1.{v}") + F.col(f"c2.{v}") + F.col(f"c3.{v}")) / 4 for v in "xy"})
    corner = lambda ring, k: {v: F.col(f"c{k}.{v}") if ring == 0 else (F.col(f"c{k}.{v}") + F.col(f"m{v}")) / 2 for v in "xy"}
    rows = [F.struct(F.lit(r).alias("ring_id"), F.lit(k).alias("seq"), *(c.alias(v) for v, c in corner(r, k).items())) for r in (0, 1) for k in range(4)]
    return c.select((1000 * F.col("gy") + F.col("gx")).alias("region_id"), F.inline(F.array(*rows)))


def cell_centres(cells: DataFrame) -> DataFrame:
    return cells.select("gx", "gy", GRID.centre_x().alias("x"), GRID.centre_y().alias("y"))


def kde_correlated(spark: SparkSession, sf: str) -> DataFrame:
    """The density of the training events in time and place, by Silverman's rule, at four times over all cells' centres; in units of 1e-9."""
    at = cell_centres(GRID.cells(spark)).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn("t", 3.0 + 6 * F.col("i"))
    found = correlated.density(with_days(spark, sf), at, ["t", "x", "y"], ["gx", "gy", "i"], "silverman")
    return found.select("gx", "gy", "i", F.round(F.col("density") * 1e9, 6).alias("density"))


def shifted(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The streets with their vertices moved off the grid's lines."""
    return points.translate(vertices, 40.0, 55.0), edges


def edge_counts(edges: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.groupBy("edge_id").agg(F.count("*").cast("double").alias("risk"))
    return edges.select("edge_id").join(counts, "edge_id", "left").fillna(0.0, ["risk"])


def from_an_edge(spark: SparkSession, sf: str, run: Callable[..., DataFrame]) -> DataFrame:
    """run(edges, edge_id, k1, k2) with ``an_edge``."""
    _, edges = streets(spark, sf)
    return run(edges, *an_edge(edges))


SEPP_GRID = GridSpec(1500.0, 1000.0, 0.0, 0.0, 4, 3)
OMEGA, THETA = 1 / 1440, 0.5


MINUTES = 21 * 1440.0


def sepp_inputs(spark: SparkSession, sf: str):
    """All events before TRAIN_END on the cells, and their rates over those ``MINUTES``."""
    events = sepp.grid_events(train(spark, sf), SEPP_GRID)
    mu = events.groupBy("gx", "gy").agg((F.count("*") / MINUTES).alias("mu"))
    return events, mu


def sepp_columns(spark: SparkSession, sf: str):
    events, mu = sepp_inputs(spark, sf)
    return events, OMEGA, THETA, mu


def sepp_em(spark: SparkSession, sf: str, corrected: bool = False) -> DataFrame:
    events, mu = sepp_inputs(spark, sf)
    omega, theta, mu = sepp.em_step(events, OMEGA, THETA, mu, MINUTES, corrected)
    return mu.select("gx", "gy", F.round("mu", 9).alias("mu"), F.round(F.lit(omega), 9).alias("omega"), F.round(F.lit(theta), 9).alias("theta"))


def sepp_predict(spark: SparkSession, sf: str) -> DataFrame:
    _, mu = sepp_inputs(spark, sf)
    return risks(sepp.predict_grid(train(spark, sf), SEPP_GRID, TRAIN_END, OMEGA, THETA, mu), 9)


#: Kernels of the predictors: days and metres.
SEPP_AT = 21.5
SEPP_MODEL = sepp_kernels.Model(
    lambda t, x, y: (1 + x / 5000) * F.exp(-y / 2000) * (1 + t / 100) / 1e6,
    lambda dt, dx, dy: F.exp(-dt / 2 - (dx * dx + dy * dy) / 12_800) / 1e5, 300.0, 10.0,
)
SEPP_SEPARABLE = sepp_kernels.Separable(
    lambda x, y: (1 + x / 5000) * F.exp(-y / 2000) / 1e6, lambda dt: F.exp(-dt / 2) / 2, lambda dx, dy: F.exp(-(dx * dx + dy * dy) / 12_800) / 4e4, 300.0, 10.0
)


def sepp_events(spark: SparkSession, sf: str) -> DataFrame:
    return sepp_kernels.time_space(pts(spark, sf))[0]


def sepp_places(spark: SparkSession) -> DataFrame:
    return sepp_kernels.grid_places(spark, GRID, 2)


def sepp_surface(risk: DataFrame, places: int) -> DataFrame:
    """Risks in units of 1e-6 at the places."""
    return risk.select("place_id", F.round(F.col("risk") * 1e6, places).alias("risk"))


def sepp_fit(spark: SparkSession, sf: str, iterations: int, probabilities: bool = True) -> sepp_kernels.Declustered:
    return sepp_kernels.fit(pts(spark, sf), iterations, time_cutoff=2.0, space_cutoff=150.0, time_bandwidth=1.0, space_bandwidth=60.0, seed=5, probabilities=probabilities)


def sepp_declustered(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's probability of being background after a round."""
    return sepp_fit(spark, sf, 1).p.where("i = j").select(F.col("i").alias("event_id"), F.col("p").alias("background"))


def sepp_fitted_predict(spark: SparkSession, sf: str) -> DataFrame:
    found = sepp_fit(spark, sf, 1, probabilities=False)  # a prediction needs the kernels alone
    events, _ = sepp_kernels.time_space(pts(spark, sf))
    return risks(sepp_kernels.on_grid(sepp_kernels.fitted_predict(found, events, sepp_kernels.grid_places(spark, GRID), found.duration), GRID), 12)


def sepp_tabulated(spark: SparkSession, sf: str) -> DataFrame:
    tables = sepp_kernels.tabulate(spark, SEPP_SEPARABLE, GRID, 0.25, 25.0)
    return sepp_surface(sepp_kernels.tabulated_predict(tables, sepp_events(spark, sf), sepp_places(spark), sepp_kernels.times_between(SEPP_AT, SEPP_AT + 7, 5)), 9)


def oracle_sql() -> dict[str, str]:
    from geopulse.plans.oracle import ORACLE

    return dict(ORACLE)
