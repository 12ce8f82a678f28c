"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

PTS = """pts AS (SELECT event_id, ts, value * 10 AS x,
  CAST(json_extract_string(props, '$.k') AS INTEGER) * 30.0::DOUBLE + (user_id % 30) AS y, event_type AS category FROM events)"""
CELL = "CAST(floor(x / 150) AS BIGINT) AS gx, CAST(floor(y / 150) AS BIGINT) AS gy"
CELLS = "cells AS (SELECT a.range AS gx, b.range AS gy, (a.range + 0.5::DOUBLE) * 150 AS mx, (b.range + 0.5::DOUBLE) * 150 AS my FROM range(33) a, range(20) b)"
TRAIN = "train AS (SELECT * FROM pts WHERE ts < TIMESTAMP '2024-01-22')"
NEXT = "nxt AS (SELECT * FROM pts WHERE ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29')"
COUNTS = f"counts AS (SELECT {CELL}, count(*) AS n FROM train GROUP BY ALL)"
BASE = f"{CELLS}, {TRAIN}, {NEXT}, {COUNTS}, base AS (SELECT gx, gy, coalesce(n, 0) + 1.0::DOUBLE AS risk FROM cells LEFT JOIN counts USING (gx, gy))"
PROB = "prob AS (SELECT gx, gy, risk / sum(risk) OVER () AS risk FROM base)"
SCORE = f"score AS (SELECT *, {CELL} FROM nxt WHERE x >= 0 AND x < 4950 AND y >= 0 AND y < 3000)"
HITS = "hits AS (SELECT gx, gy, count(*) AS count FROM score GROUP BY ALL)"
FRACTION = "f AS (SELECT p.gx, p.gy, p.risk AS p, coalesce(count, 0) AS count, coalesce(count, 0) / (sum(coalesce(count, 0)) OVER ())::DOUBLE AS u FROM prob p LEFT JOIN hits USING (gx, gy))"
SCORED = f"WITH {PTS}, {BASE}, {PROB}, {SCORE}, {HITS}, {FRACTION}"
KL = "CASE WHEN {u} <= 0 THEN 0 WHEN {p} <= 0 THEN {u} * (ln({u}) + 20) ELSE {u} * ln({u} / {p}) END"
KLS = f"({KL.format(u='u', p='p')} + {KL.format(u='(1 - u)', p='(1 - p)')})"
LEVELS = "(SELECT unnest([1, 5, 10, 20, 50])::INTEGER AS coverage) l"


def weighed(weight: str, reach: str, source: str = "train") -> str:
    return f"""WITH {PTS}, {TRAIN}, {CELLS}, w AS (SELECT gx, gy, sum({weight}) AS r FROM cells c JOIN {source} t
      ON {reach} GROUP BY ALL) SELECT gx, gy, round(coalesce(r, 0), 6) AS risk FROM cells LEFT JOIN w USING (gx, gy)"""


D2 = "((mx - x) * (mx - x) + (my - y) * (my - y))"


def prospective(distance: str) -> str:
    return f"""WITH {PTS}, {TRAIN}, {CELLS}, e AS (SELECT {CELL}, (epoch_us(TIMESTAMP '2024-01-22') - epoch_us(ts)) // 86400000000 AS age FROM train),
    w AS (SELECT c.gx, c.gy, sum(CASE WHEN {distance} < 8 THEN 1 / ((1 + {distance}) * (1 + age::DOUBLE)) ELSE 0 END) AS r
      FROM cells c JOIN e ON abs(c.gx - e.gx) < 8 AND abs(c.gy - e.gy) < 8 AND age < 8 GROUP BY ALL)
    SELECT gx, gy, round(coalesce(r, 0), 6) AS risk FROM cells LEFT JOIN w USING (gx, gy)"""


def subgrid(weight: str, reach: str, extra: str = "") -> str:
    return f"""WITH {PTS}, {TRAIN}, {CELLS}, s AS (SELECT a.range AS fx, b.range AS fy, (a.range + 0.5::DOUBLE) * 75 AS mx, (b.range + 0.5::DOUBLE) * 75 AS my FROM range(66) a, range(40) b),
    t AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-22') - epoch_us(ts)) / 86400000000.0::DOUBLE AS age FROM train),
    w AS (SELECT fx // 2 AS gx, fy // 2 AS gy, sum({weight}) / 4 AS r FROM s JOIN t ON {reach} GROUP BY ALL)
    SELECT gx, gy, round(coalesce(r, 0), 6) AS risk FROM cells LEFT JOIN w USING (gx, gy)"""


def kde(weight: str, moments: str) -> str:
    return f"""WITH {PTS}, {TRAIN}, {CELLS},
    e AS (SELECT x, y, {weight} AS w FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-22') - epoch_us(ts)) / 86400000000.0::DOUBLE AS age FROM train)),
    m AS (SELECT {moments}, sum(w) AS sw FROM e), k AS (SELECT *, sxx * syy - sxy * sxy AS det FROM m)
    SELECT gx, gy, round(sum(w * exp(-((mx - x) * (mx - x) * syy - 2 * (mx - x) * (my - y) * sxy + (my - y) * (my - y) * sxx) / det / (2 * h * h))
      / (sw * sqrt(det) * 2 * pi() * h * h)), 12) AS risk FROM cells, e, k GROUP BY gx, gy"""


SCOTT = "var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy, pow(count(*), -1 / 6.0::DOUBLE) AS h"
FIXED = "1.0::DOUBLE AS sxx, 1.0::DOUBLE AS syy, 0.0::DOUBLE AS sxy, {h}::DOUBLE AS h"
STREETS = f"""{PTS.replace("pts AS", "all_pts AS", 1)},
 v AS (SELECT 100 * j + i AS key, i * 150.0::DOUBLE AS x, j * 150.0::DOUBLE AS y, i, j, n FROM (SELECT CAST(floor(x / 150) AS BIGINT) AS i, CAST(floor(y / 150) AS BIGINT) AS j, count(*) AS n FROM all_pts GROUP BY ALL)
   WHERE i BETWEEN 0 AND 32 AND j BETWEEN 0 AND 19),
 edges AS (SELECT 2 * a.key + (b.j - a.j) AS edge_id, a.key AS k1, b.key AS k2, 150.0::DOUBLE AS length FROM v a JOIN v b ON (b.i = a.i + 1 AND b.j = a.j OR b.i = a.i AND b.j = a.j + 1) AND (a.n + b.n) % 5 <> 0),
 both_ways AS (SELECT edge_id, k1 AS a, k2 AS b, length FROM edges UNION ALL SELECT edge_id, k2, k1, length FROM edges),
 deg AS (SELECT a AS key, count(*) AS degree FROM both_ways GROUP BY a),
 own AS (SELECT edge_id, k1, k2 FROM edges WHERE edge_id >= 604 AND edge_id % 2 = 0 ORDER BY edge_id LIMIT 1)"""
#: The cells that hold events, in place of all cells.
OCCUPIED = f"{PTS}, cells AS (SELECT DISTINCT {CELL}, (floor(x / 150) + 0.5::DOUBLE) * 150 AS mx, (floor(y / 150) + 0.5::DOUBLE) * 150 AS my FROM pts WHERE x >= 0 AND x < 4950 AND y >= 0 AND y < 3000)"
SEGMENTS = "s(segment_id, x1, y1, x2, y2) AS (VALUES (1, 100.0::DOUBLE, 120.0::DOUBLE, 940.0::DOUBLE, 610.0::DOUBLE), (2, 1000.0, 330.0, 1000.0, 990.0), (3, 2000.0, 1210.0, 1430.0, 1210.0), (4, 505.0, 2405.0, 1210.0, 1705.0))"
NEAREST = """c AS (SELECT event_id, segment_id, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM {p}, {s}),
 n AS (SELECT *, pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2) AS d2 FROM c),
 k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(d2, 9), segment_id) AS k FROM n WHERE d2 <= {r} * {r}::DOUBLE)"""
STREET_EVENTS = f"""{PTS}, {STREETS},
 seg AS (SELECT e.edge_id AS segment_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges e JOIN v a ON a.key = e.k1 JOIN v b ON b.key = e.k2),
 {NEAREST.format(p="pts", s="seg", r=75)}, ev AS (SELECT event_id, segment_id AS edge_id, t FROM k WHERE k = 1)"""
TRI = "((least({b}, 320.0) - least({a}, 320.0)) * (2 * 320.0 - least({a}, 320.0) - least({b}, 320.0)) / (2 * 320.0 * 320.0))::DOUBLE"
NET_COVER = """risks AS (SELECT edge_id, length, coalesce(n, 0) AS risk FROM edges LEFT JOIN (SELECT edge_id, count(*) AS n FROM ev GROUP BY edge_id) USING (edge_id)),
 run AS (SELECT edge_id, sum(length) OVER (ORDER BY risk DESC, edge_id) AS upto, sum(length) OVER () AS total FROM risks),
 cover AS (SELECT edge_id FROM run WHERE upto <= total * 0.2::DOUBLE)"""
PERIODS = "r AS (SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(a + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS end_, a, a + INTERVAL 7 DAY AS b FROM (SELECT unnest([TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-22']) AS a))"
BACKTEST = f"""{PTS}, {CELLS}, {PERIODS}, seen AS (SELECT start, gx, gy, count(*) FILTER (ts < a) AS risk, count(*) FILTER (ts >= a) AS count
   FROM (SELECT ts, {CELL} FROM pts) JOIN r ON ts < b GROUP BY ALL),
 ranked AS (SELECT r.start, r.end_, coalesce(count, 0) AS count, row_number() OVER (PARTITION BY r.start ORDER BY coalesce(risk, 0) DESC, gy DESC, gx DESC) AS rank
   FROM r CROSS JOIN cells LEFT JOIN seen USING (start, gx, gy)),
 total AS (SELECT start, sum(count) AS total FROM seen GROUP BY start),
 bt AS (SELECT start, end_ AS "end", coverage, CAST(sum(count) FILTER (rank <= floor(660 * (coverage / 100.0::DOUBLE))) AS BIGINT) AS hits, CAST(any_value(total) AS BIGINT) AS total
   FROM ranked JOIN total USING (start), {LEVELS} GROUP BY start, end_, coverage)"""
POLY = "poly(x1, y1, x2, y2) AS (VALUES (310.0::DOUBLE, 205.0::DOUBLE, 2905.0::DOUBLE, 410.0::DOUBLE), (2905.0, 410.0, 2505.0, 2610.0), (2505.0, 2610.0, 1105.0, 2210.0), (1105.0, 2210.0, 310.0, 205.0))"
SEPP = f"""{PTS}, week AS (SELECT * FROM pts WHERE ts < TIMESTAMP '2024-01-22'),
 ev AS (SELECT CAST(floor(x / 1500) AS BIGINT) AS gx, CAST(floor(y / 1000) AS BIGINT) AS gy, event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM week)) / 60000000.0::DOUBLE AS t FROM week WHERE x >= 0 AND x < 6000 AND y >= 0 AND y < 3000),
 mu AS (SELECT gx, gy, count(*) / 30240.0::DOUBLE AS mu FROM ev GROUP BY ALL),
 raw AS (SELECT gx, gy, event_id AS i, event_id AS j, 0.0::DOUBLE AS dt, mu AS p FROM ev JOIN mu USING (gx, gy)
   UNION ALL SELECT a.gx, a.gy, a.event_id, b.event_id, b.t - a.t, 0.5::DOUBLE * (1 / 1440.0::DOUBLE) * exp(-(1 / 1440.0::DOUBLE) * (b.t - a.t)) FROM ev a JOIN ev b ON a.gx = b.gx AND a.gy = b.gy AND b.t > a.t),
 pm AS (SELECT gx, gy, i, j, dt, p / sum(p) OVER (PARTITION BY j) AS p FROM raw)"""
DIGAMMA = "(ln({x} + 6) - 1 / (2 * ({x} + 6)) - 1 / (12 * pow({x} + 6, 2)) + 1 / (120 * pow({x} + 6, 4)) - 1 / (252 * pow({x} + 6, 6)) - 1 / {x} - 1 / ({x} + 1) - 1 / ({x} + 2) - 1 / ({x} + 3) - 1 / ({x} + 4) - 1 / ({x} + 5))"
#: The parts of the shifted streets in the grid's cells.
STREET_PARTS = """ends AS (SELECT e.edge_id, a.x + 40 AS x1, a.y + 55 AS y1, b.x + 40 AS x2, b.y + 55 AS y2, b.x - a.x AS dx, b.y - a.y AS dy FROM edges e JOIN v a ON a.key = k1 JOIN v b ON b.key = k2),
 cut AS (SELECT edge_id, gx, gy, x1, y1, dx, dy, greatest(0, CASE WHEN dx = 0 THEN 0 ELSE least((gx * 150 - x1) / dx, (gx * 150 + 150 - x1) / dx) END, CASE WHEN dy = 0 THEN 0 ELSE least((gy * 150 - y1) / dy, (gy * 150 + 150 - y1) / dy) END) AS t1,
   least(1, CASE WHEN dx = 0 THEN 1 ELSE greatest((gx * 150 - x1) / dx, (gx * 150 + 150 - x1) / dx) END, CASE WHEN dy = 0 THEN 1 ELSE greatest((gy * 150 - y1) / dy, (gy * 150 + 150 - y1) / dy) END) AS t2
   FROM ends, cells WHERE (dx <> 0 OR (x1 >= gx * 150 AND x1 < gx * 150 + 150)) AND (dy <> 0 OR (y1 >= gy * 150 AND y1 < gy * 150 + 150))),
 part AS (SELECT * FROM cut WHERE t1 < t2)"""
OK_CELLS = "ok AS (SELECT DISTINCT gx, gy, mx, my FROM cells JOIN train ON x >= gx * 150 AND x <= (gx + 1) * 150 AND y >= gy * 150 AND y <= (gy + 1) * 150)"


def edge_corrected(events: str, h: int) -> str:
    """(gx, gy, risk) of the valid cells."""
    return f"""d AS (SELECT ok.gx AS gx, ok.gy AS gy, mx, my, sum(exp(-((mx - x) * (mx - x) + (my - y) * (my - y)) / {2 * h * h})) / (count(*) * 2 * pi() * {h * h}) AS r FROM ok, {events} GROUP BY ALL),
      cloud AS (SELECT gx AS cx, gy AS cy, CAST(floor((mx + {h} * sqrt(-2 * ln(1 - (i.range + 0.5::DOUBLE) / 10)) * cos(a.range * (2 * pi() / 100))) / 150) AS BIGINT) AS gx,
        CAST(floor((my + {h} * sqrt(-2 * ln(1 - (i.range + 0.5::DOUBLE) / 10)) * sin(a.range * (2 * pi() / 100))) / 150) AS BIGINT) AS gy FROM ok, range(10) i, range(100) a),
      f AS (SELECT cx AS gx, cy AS gy, count(*) / 1000.0::DOUBLE AS factor FROM cloud JOIN ok USING (gx, gy) GROUP BY cx, cy),
      corrected AS (SELECT gx, gy, r / factor AS risk FROM d JOIN f USING (gx, gy))"""


def relaxed(k: int) -> str:
    """Rounds of shortest distances from the events to vertices: the least (distance, last edge, share) of each."""
    ext = "SELECT event_id, w.b AS vtx, {{'d': s.d + length, 'via': edge_id, 'w': s.w / split}} AS s FROM k{0} JOIN w ON w.a = k{0}.vtx AND w.edge_id <> s.via WHERE s.d + length < 320"
    return ", ".join(f"k{i + 1} AS (SELECT event_id, vtx, min(s) AS s FROM (SELECT * FROM k{i} UNION ALL {ext.format(i)}) GROUP BY ALL)" for i in range(k))


DAYS = f"{PTS}, days AS (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0::DOUBLE AS t FROM pts WHERE ts < TIMESTAMP '2024-01-22')"


def bandwidths(dims: str, k: int, near: float) -> str:
    """h (event_id, h2): squared distance to the k-th neighbour in coordinates of unit variance, looked for within ``near`` first; m: the deviations."""
    u = ", ".join(f"{c} / s{c} AS u{c}" for c in dims)
    d2 = " + ".join(f"pow(a.u{c} - b.u{c}, 2)" for c in dims)
    box = " AND ".join(f"abs(a.u{c} - b.u{c}) <= {near}" for c in dims)
    ranked = "SELECT a.event_id, {d2} AS d2, row_number() OVER (PARTITION BY a.event_id ORDER BY {d2}) AS k FROM {a} a JOIN u b ON a.event_id <> b.event_id"
    return f"""m AS (SELECT count(*) AS n, {", ".join(f"stddev_samp({c}) AS s{c}" for c in dims)} FROM days), u AS (SELECT event_id, {u} FROM days, m),
      d AS ({ranked.format(d2=d2, a="u")} AND {box}), far AS (SELECT event_id FROM u EXCEPT SELECT event_id FROM d WHERE k = {k} AND d2 <= {near * near}),
      e AS ({ranked.format(d2=d2, a="(SELECT * FROM u SEMI JOIN far USING (event_id))")}),
      h AS (SELECT event_id, CASE WHEN d2 = 0 THEN 1 ELSE d2 END AS h2 FROM (SELECT event_id, d2 FROM d WHERE k = {k} AND d2 <= {near * near} UNION ALL SELECT event_id, d2 FROM e WHERE k = {k}))"""


INSIDE = "(SELECT {id} FROM {at} JOIN poly ON (poly.y1 > py) <> (poly.y2 > py) AND px < (poly.x2 - poly.x1) * (py - poly.y1) / (poly.y2 - poly.y1) + poly.x1 GROUP BY ALL HAVING count(*) % 2 = 1)"
AREA = f"""centre AS (SELECT gx, gy, mx AS px, my AS py FROM cells),
      crossed AS (SELECT gx, gy FROM cells, poly WHERE greatest(0, least((gx * 150 - x1) / (x2 - x1), (gx * 150 + 150 - x1) / (x2 - x1)), least((gy * 150 - y1) / (y2 - y1), (gy * 150 + 150 - y1) / (y2 - y1)))
        < least(1, greatest((gx * 150 - x1) / (x2 - x1), (gx * 150 + 150 - x1) / (x2 - x1)), greatest((gy * 150 - y1) / (y2 - y1), (gy * 150 + 150 - y1) / (y2 - y1)))),
      area AS (SELECT * FROM {INSIDE.format(id="gx, gy", at="centre")} UNION SELECT gx, gy FROM crossed)"""
WAVES = "(1 + sin(x / 300)) * exp(-y / 2000)"


def sampled(cells: str, samples: int) -> str:
    return f"""SELECT gx, gy, round(avg({WAVES}), 9) AS risk FROM (SELECT gx, gy, (gx + (i.range + 0.5::DOUBLE) / {samples}) * 150 AS x, (gy + (j.range + 0.5::DOUBLE) / {samples}) * 150 AS y
      FROM {cells}, range({samples}) i, range({samples}) j) GROUP BY gx, gy"""


def side(p: str, q: str, r: str) -> str:
    return f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


EDGE_STEPS = """r AS (SELECT k1 AS key, {d1}::DOUBLE AS d, 0 AS steps FROM own UNION SELECT k2, {d2}::DOUBLE, 0 FROM own
      UNION SELECT b.b, r.d + 150, steps + 1 FROM r JOIN both_ways b ON r.key = b.a WHERE steps < 150), best AS (SELECT key, min(d) AS distance FROM r GROUP BY key)"""

#: Events in days since the first one, and 2 x 2 places in each cell.
PAST = f"""{PTS}, {CELLS}, ev AS (SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM pts)) / 86400000000.0::DOUBLE AS t, x, y FROM pts),
 places AS (SELECT b.range * 66 + a.range AS place_id, (a.range + 0.5::DOUBLE) * 75 AS px, (b.range + 0.5::DOUBLE) * 75 AS py FROM range(66) a, range(40) b)"""
OWN = "(1 + px / 5000) * exp(-py / 2000) * (1 + {t} / 100) / 1e6::DOUBLE"
TRIGGER = "exp(-{dt} / 2 - d2 / 12800) / 1e5::DOUBLE"
MET = "met AS (SELECT place_id, t, pow(px - x, 2) + pow(py - y, 2) AS d2, px - x AS dx, py - y AS dy FROM places, ev WHERE abs(px - x) <= {r} AND abs(py - y) <= {r})"


def at_times(samples: int) -> str:
    return f"clock AS (SELECT 21.5::DOUBLE + 7.0::DOUBLE * range / {samples - 1} AS u FROM range({samples}))"


def at_places(background: str, rates: str) -> str:
    return f"SELECT place_id, round(({background} + coalesce(rate, 0)) * 1000000, 9) AS risk FROM places LEFT JOIN (SELECT place_id, sum(rate) AS rate FROM {rates} GROUP BY place_id) USING (place_id)"


def least(table: str) -> str:
    """The largest of the least heights that make up a thousandth."""
    return f"(SELECT max(height) FROM (SELECT height, sum(height) OVER (ORDER BY height ROWS UNBOUNDED PRECEDING) AS upto, sum(height) OVER () AS total FROM {table}) WHERE upto <= total * 0.001::DOUBLE)"


POINT = f"pt AS (SELECT place_id, {TRIGGER.format(dt='(21.5::DOUBLE - t)')} AS rate FROM met WHERE d2 <= 90000 AND t < 21.5::DOUBLE AND t >= 11.5::DOUBLE)"

ORACLE: dict[str, str] = {
    "sepp_background_predict": f"WITH {PAST} SELECT place_id, round({OWN.format(t='21.5::DOUBLE')} * 1000000, 9) AS risk FROM places",
    "sepp_point_predict": f"WITH {PAST}, {MET.format(r=300)}, {POINT} {at_places(OWN.format(t='21.5::DOUBLE'), 'pt')}",
    "sepp_range_predict": f"""WITH {PAST}, {MET.format(r=300)}, {at_times(20)},
      rt AS (SELECT place_id, {TRIGGER.format(dt='(u - t)')} / 20 AS rate FROM met, clock WHERE d2 <= 90000 AND t < u AND u - t <= 10)
      {at_places(OWN.format(t='25.0::DOUBLE'), 'rt')}""",
    "sepp_separable_predict": f"""WITH {PAST}, {MET.format(r=300)}, {at_times(5)},
      rt AS (SELECT place_id, exp(-(u - t) / 2) / 2 * exp(-d2 / 12800) / 4e4::DOUBLE / 5 AS rate FROM met, clock WHERE d2 <= 90000 AND t < 21.5::DOUBLE AND u - t <= 10)
      {at_places(OWN.format(t='0'), 'rt')}""",
    "sepp_tabulated_predict": f"""WITH {PAST}, {MET.format(r=1200)}, {at_times(5)},
      tt AS (SELECT range AS band, exp(-0.25::DOUBLE * range / 2) / 2 AS height FROM range(100)),
      tk AS (SELECT * FROM tt WHERE band <= (SELECT max(band) FROM tt WHERE height > {least('tt')})),
      st AS (SELECT n.range AS n, a.range - n.range AS ox, b.range - n.range AS oy, avg(exp(-(pow((a.range - n.range + (i.range + 0.5::DOUBLE) / 5) * 25, 2) + pow((b.range - n.range + (j.range + 0.5::DOUBLE) / 5) * 25, 2)) / 12800) / 4e4::DOUBLE) AS height
        FROM (SELECT unnest([10, 20, 40]) AS range) n, range(80) a, range(80) b, range(5) i, range(5) j WHERE a.range < 2 * n.range AND b.range < 2 * n.range GROUP BY ALL),
      least_mass AS (SELECT n, max(height) AS cut FROM (SELECT n, height, sum(height) OVER (PARTITION BY n ORDER BY height ROWS UNBOUNDED PRECEDING) AS upto, sum(height) OVER (PARTITION BY n) AS total FROM st) WHERE upto <= total * 0.001::DOUBLE GROUP BY n),
      -- the least size beyond whose rim nothing but the least mass is
      sized AS (SELECT min(n) AS n FROM least_mass WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.n = least_mass.n AND sqrt(ox * ox + oy * oy) >= st.n * 80 // 100 AND height > cut)),
      sk AS (SELECT ox, oy, height FROM st JOIN sized USING (n)),
      e AS (SELECT place_id, dx, dy, u - t AS dt FROM met, clock WHERE t < 21.5::DOUBLE),
      rt AS (SELECT place_id, tk.height * sk.height / 5 AS rate FROM e JOIN tk ON band = floor(dt / 0.25::DOUBLE) JOIN sk ON ox = floor(dx / 25) AND oy = floor(dy / 25)),
      bg AS (SELECT gx, gy, avg((1 + (gx + (i.range + 0.5::DOUBLE) / 5) * 150 / 5000) * exp(-(gy + (j.range + 0.5::DOUBLE) / 5) * 150 / 2000) / 1e6::DOUBLE) AS own FROM cells, range(5) i, range(5) j GROUP BY gx, gy)
      {at_places('own', 'rt').replace('FROM places', 'FROM (SELECT * FROM places JOIN bg ON gx = floor(px / 150) AND gy = floor(py / 150)) places', 1)}""",
    "sepp_log_likelihood": f"""WITH {PAST}, pair AS (SELECT b.event_id, sum(exp(-(b.t - a.t) / 2 - (pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) / 12800) / 1e5::DOUBLE) AS rate FROM ev a JOIN ev b
        ON b.t > a.t AND b.t - a.t <= 10 AND abs(a.x - b.x) <= 300 AND pow(b.x - a.x, 2) + pow(b.y - a.y, 2) <= 90000 GROUP BY b.event_id)
      SELECT round(sum(ln((1 + x / 5000) * exp(-y / 2000) * (1 + t / 100) / 1e6::DOUBLE + coalesce(rate, 0))), 3) AS likelihood FROM ev LEFT JOIN pair USING (event_id)""",
    "sepp_grid_predict": f"""WITH {PAST}, {TRAIN}, {MET.format(r=300)}, {POINT}, {OK_CELLS},
      p AS (SELECT CAST(floor(px / 150) AS BIGINT) AS gx, CAST(floor(py / 150) AS BIGINT) AS gy, {OWN.format(t='21.5::DOUBLE')} + coalesce(rate, 0) AS risk FROM places LEFT JOIN (SELECT place_id, sum(rate) AS rate FROM pt GROUP BY place_id) USING (place_id)),
      m AS (SELECT gx, gy, avg(risk) AS risk FROM p JOIN ok USING (gx, gy) GROUP BY gx, gy) SELECT gx, gy, round(risk / sum(risk) OVER (), 9) AS risk FROM m""",
    "kde_mixture_3d": f"""WITH {DAYS}, {bandwidths("txy", 15, 0.9)}, p AS (SELECT a.range AS i0, b.range AS i1, c.range AS i2, 3 + 6.0::DOUBLE * a.range AS pt, 400 + 700.0::DOUBLE * b.range AS px, 300 + 500.0::DOUBLE * c.range AS py FROM range(4) a, range(5) b, range(5) c),
      v AS (SELECT i0, i1, i2, round(sum(exp(-(pow((pt - t) / st, 2) + pow((px - x) / sx, 2) + pow((py - y) / sy, 2)) / (2 * h2)) / pow(2 * pi() * h2, 1.5) / (n * st * sx * sy)), 15) AS density FROM p, m, days JOIN h USING (event_id) GROUP BY ALL)
      SELECT i0::INTEGER AS i0, i1::INTEGER AS i1, i2::INTEGER AS i2, density FROM v WHERE density > 0""",
    "kde_mixture_marginal": f"""WITH {DAYS}, {bandwidths("txy", 15, 0.9)}, v AS (SELECT range AS i0, round(sum(exp(-pow((250.0::DOUBLE * range - x) / sx, 2) / (2 * h2)) / sqrt(2 * pi() * h2) / (n * sx)), 12) AS density FROM range(16), m, days JOIN h USING (event_id) GROUP BY ALL)
      SELECT i0::INTEGER AS i0, density FROM v WHERE density > 0""",
    "kde_reflected_time": f"""WITH {DAYS}, {bandwidths("t", 100, 0.2)}, v AS (SELECT range AS i0, round(sum((exp(-pow((range / 2.0::DOUBLE - t) / st, 2) / (2 * h2)) + exp(-pow((range / 2.0::DOUBLE + t) / st, 2) / (2 * h2))) / sqrt(2 * pi() * h2) / (n * st)), 9) AS density FROM range(40), m, days JOIN h USING (event_id) GROUP BY ALL)
      SELECT i0::INTEGER AS i0, density FROM v WHERE density > 0""",
    "prediction_from_kernel": f"WITH {OCCUPIED} {sampled('cells', 4)}",
    "prediction_masked": f"WITH {PTS}, {TRAIN}, {CELLS}, {OK_CELLS} {sampled('ok', 3)}",
    "grid_mask_area": f"WITH {OCCUPIED}, {POLY}, {AREA} SELECT gx, gy FROM area",
    "surface_cropped": f"WITH {PTS}, {BASE}, {POLY}, {AREA} SELECT base.gx, base.gy, risk, area.gx IS NOT NULL AS valid FROM base LEFT JOIN area USING (gx, gy)",
    "segments_meeting_polygon": f"""WITH {STREETS}, {POLY}, e AS (SELECT edge_id, a.x AS ux, a.y AS uy, b.x AS wx, b.y AS wy FROM edges JOIN v a ON a.key = k1 JOIN v b ON b.key = k2),
      q AS (SELECT x1 AS cx, y1 AS cy, x2 AS dx, y2 AS dy FROM poly), tips AS (SELECT edge_id, ux AS px, uy AS py FROM e UNION SELECT edge_id, wx, wy FROM e)
      SELECT edge_id AS segment_id FROM {INSIDE.format(id="edge_id, px, py", at="tips")} UNION SELECT edge_id FROM e, q WHERE {side("u", "w", "c")} * {side("u", "w", "d")} <= 0 AND {side("c", "d", "u")} * {side("c", "d", "w")} <= 0
        AND greatest(ux, wx) >= least(cx, dx) AND least(ux, wx) <= greatest(cx, dx) AND greatest(uy, wy) >= least(cy, dy) AND least(uy, wy) <= greatest(cy, dy)""",
    "graph_edge_paths": f"WITH RECURSIVE {STREETS}, {EDGE_STEPS.format(d1=37.5, d2=112.5)} SELECT key, distance FROM best",
    "graph_edge_distances": f"WITH RECURSIVE {STREETS}, {EDGE_STEPS.format(d1=75, d2=75)} SELECT edge_id, CASE WHEN edge_id = (SELECT edge_id FROM own) THEN 0 ELSE min(distance) + 75 END AS distance FROM both_ways JOIN best ON a = key GROUP BY edge_id",
    "network_places": f"WITH {STREET_EVENTS} SELECT event_id, round(x1 * (1 - t) + x2 * t, 6) AS x, round(y1 * (1 - t) + y2 * t, 6) AS y FROM ev JOIN seg ON segment_id = edge_id",
    "grid_risk_subdivided": f"""WITH {PTS}, {BASE}, {STREETS}, {STREET_PARTS} SELECT edge_id, row_number() OVER (PARTITION BY edge_id ORDER BY t1, gx, gy)::INTEGER AS part, round(part.x1 + dx * t1, 6) AS x1, round(part.y1 + dy * t1, 6) AS y1,
      round(part.x1 + dx * t2, 6) AS x2, round(part.y1 + dy * t2, 6) AS y2, round((t2 - t1) * 150, 6) AS length, coalesce(risk, 0) AS risk FROM part LEFT JOIN base USING (gx, gy)""",
    "backtest_rates": f"""WITH {PTS}, {CELLS}, {PERIODS}, seen AS (SELECT start, gx, gy, count(*) FILTER (ts < a) AS risk, count(*) FILTER (ts >= a) AS count FROM (SELECT ts, {CELL} FROM pts) JOIN r ON ts < b GROUP BY ALL),
      ranked AS (SELECT r.start, r.end_, coalesce(count, 0) AS count, row_number() OVER (PARTITION BY r.start ORDER BY coalesce(risk, 0) DESC, gy DESC, gx DESC) AS rank FROM r CROSS JOIN cells LEFT JOIN seen USING (start, gx, gy)),
      total AS (SELECT start, sum(count) AS total FROM seen GROUP BY start)
      SELECT 'naive' AS predictor, start, end_ AS "end", {", ".join(f'round(coalesce(sum(count) FILTER (rank <= floor(660 * ({c} / 100.0::DOUBLE))), 0) / any_value(total), 6) AS "{c}%"' for c in range(1, 101))}
      FROM ranked JOIN total USING (start) WHERE start >= '2024-01-15' GROUP BY start, end_""",
    "seppexp_em_corrected": f"""WITH {SEPP}, o AS (SELECT sum(p) AS s, sum(p * dt) AS st FROM pm WHERE i <> j), late AS (SELECT count(*) AS n, sum(exp(-(30240 - t) / 1440)) AS s, sum((30240 - t) * exp(-(30240 - t) / 1440)) AS st FROM ev)
      SELECT gx, gy, round(sum(p) / 30240.0::DOUBLE, 9) AS mu, round(any_value(o.s / (o.st + 0.5 * late.st)), 9) AS omega, round(any_value(o.s / (late.n - late.s)), 9) AS theta FROM pm, o, late WHERE i = j GROUP BY gx, gy""",
    "graph_reduced": f"""WITH RECURSIVE {STREETS}, two AS (SELECT s.edge_id AS e, t.edge_id AS f FROM both_ways s JOIN both_ways t ON s.a = t.a AND s.edge_id <> t.edge_id JOIN deg ON deg.key = s.a AND degree = 2),
      r AS (SELECT edge_id, edge_id AS c FROM edges UNION SELECT f, c FROM r JOIN two ON r.edge_id = two.e), seg AS (SELECT edge_id, min(c) AS segment FROM r GROUP BY edge_id),
      tips AS (SELECT segment, a FROM both_ways JOIN seg USING (edge_id) GROUP BY ALL HAVING count(*) = 1), bounds AS (SELECT segment, min(a) AS k1, max(a) AS k2 FROM tips GROUP BY segment HAVING count(*) = 2),
      whole AS (SELECT segment, sum(length) AS length FROM edges JOIN seg USING (edge_id) GROUP BY segment),
      merged AS (SELECT segment, k1, k2, length FROM bounds JOIN whole USING (segment) QUALIFY count(*) OVER (PARTITION BY k1, k2) = 1)
      SELECT k1, k2, length FROM merged UNION ALL SELECT k1, k2, length FROM edges JOIN seg USING (edge_id) WHERE segment NOT IN (SELECT segment FROM merged)""",
    "network_approx": f"""WITH {STREET_EVENTS}, w AS (SELECT b.*, greatest(degree - 1, 1)::DOUBLE AS split FROM both_ways b JOIN deg ON deg.key = b.a), st AS (SELECT e.*, k1, k2, length FROM ev e JOIN edges USING (edge_id)),
      k0 AS (SELECT event_id, vtx, min(s) AS s FROM (SELECT event_id, k2 AS vtx, {{'d': length * (1 - t), 'via': edge_id, 'w': 1.0::DOUBLE}} AS s FROM st UNION ALL SELECT event_id, k1, {{'d': length * t, 'via': edge_id, 'w': 1.0::DOUBLE}} FROM st) WHERE s.d < 320 GROUP BY ALL),
      {relaxed(3)},
      z AS (SELECT edge_id, ({TRI.format(a='0.0', b='length * (1 - t)')} + {TRI.format(a='0.0', b='length * t')}) / length AS v FROM st
        UNION ALL SELECT edge_id, s.w / split * {TRI.format(a='s.d', b='(s.d + length)')} / length FROM k3 JOIN w ON w.a = k3.vtx AND w.edge_id <> s.via)
      SELECT edge_id, round(coalesce(sum(v), 0), 6) AS risk FROM edges LEFT JOIN z USING (edge_id) GROUP BY edge_id""",
    "grid_mask_polygon": f"""WITH {OCCUPIED}, {POLY}, corner AS (SELECT gx, gy, (gx + i.range) * 150.0::DOUBLE AS x, (gy + j.range) * 150.0::DOUBLE AS y FROM cells, range(2) i, range(2) j),
      inside AS (SELECT gx, gy FROM corner JOIN poly ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY gx, gy, x, y HAVING count(*) % 2 = 1),
      crossed AS (SELECT gx, gy FROM cells, poly WHERE greatest(0, least((gx * 150 - x1) / (x2 - x1), (gx * 150 + 150 - x1) / (x2 - x1)), least((gy * 150 - y1) / (y2 - y1), (gy * 150 + 150 - y1) / (y2 - y1)))
        <= least(1, greatest((gx * 150 - x1) / (x2 - x1), (gx * 150 + 150 - x1) / (x2 - x1)), greatest((gy * 150 - y1) / (y2 - y1), (gy * 150 + 150 - y1) / (y2 - y1))))
      SELECT gx, gy FROM inside UNION SELECT gx, gy FROM crossed""",
    "grid_coverage_to_graph": f"""WITH {PTS}, {BASE}, {STREETS}, {STREET_PARTS}, top AS (SELECT gx, gy FROM base QUALIFY row_number() OVER (ORDER BY risk DESC, gy DESC, gx DESC) <= 66)
      SELECT edge_id FROM part JOIN top USING (gx, gy) GROUP BY edge_id HAVING sum(t2 - t1) >= 0.5""",
    "grid_risk_to_graph": f"""WITH {PTS}, {BASE}, {STREETS}, {STREET_PARTS}, main AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY round(t2 - t1, 9) DESC, t1, gx, gy) = 1)
      SELECT edge_id, coalesce(risk, 0) AS risk FROM main LEFT JOIN base USING (gx, gy)""",
    "bayes_dirichlet": f"""{SCORED}, a AS (SELECT count, CASE WHEN p <= 0 THEN 1e-10 ELSE p * 10 END AS a FROM f),
      s AS (SELECT sum(a) AS sa, sum(a + count) AS sb, sum(lgamma(a) - lgamma(a + count) + count * {DIGAMMA.format(x='(a + count)')}) AS t FROM a)
      SELECT round(lgamma(sb) - lgamma(sa) + t - (sb - sa) * {DIGAMMA.format(x='sb')}, 4) AS score FROM s""",
    "kde_score": f"""WITH {PTS}, {BASE}, {SCORE}, {OK_CELLS}, m AS (SELECT gx, gy, risk / sum(risk) OVER () AS p FROM base JOIN ok USING (gx, gy)), {edge_corrected("score", 300)},
      t AS (SELECT gx, gy, risk / sum(risk) OVER () AS q FROM corrected) SELECT round(sum((p - q) * (p - q)) * 22500, 6) AS score FROM m JOIN t USING (gx, gy)""",
    "kde_knn": f"""WITH {PTS}, {TRAIN}, {CELLS}, m AS (SELECT count(*) AS n, stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM train),
      u AS (SELECT event_id, x / sx AS u, y / sy AS v FROM train, m),
      d AS (SELECT a.event_id, pow(a.u - b.u, 2) + pow(a.v - b.v, 2) AS d2, row_number() OVER (PARTITION BY a.event_id ORDER BY pow(a.u - b.u, 2) + pow(a.v - b.v, 2)) AS k FROM u a JOIN u b ON a.event_id <> b.event_id AND abs(a.u - b.u) <= 0.6 AND abs(a.v - b.v) <= 0.6),
      far AS (SELECT event_id FROM u EXCEPT SELECT event_id FROM d WHERE k = 15 AND d2 <= 0.36),
      e AS (SELECT a.event_id, pow(a.u - b.u, 2) + pow(a.v - b.v, 2) AS d2, row_number() OVER (PARTITION BY a.event_id ORDER BY pow(a.u - b.u, 2) + pow(a.v - b.v, 2)) AS k FROM (SELECT * FROM u SEMI JOIN far USING (event_id)) a JOIN u b ON a.event_id <> b.event_id),
      h AS (SELECT event_id, CASE WHEN d2 = 0 THEN 1 ELSE d2 END AS h2 FROM (SELECT event_id, d2 FROM d WHERE k = 15 AND d2 <= 0.36 UNION ALL SELECT event_id, d2 FROM e WHERE k = 15))
      SELECT gx, gy, round(sum(exp(-(pow((mx - x) / sx, 2) + pow((my - y) / sy, 2)) / (2 * h2)) / h2) / any_value(n * sx * sy * 2 * pi()), 12) AS risk FROM cells, m, train JOIN h USING (event_id) GROUP BY gx, gy""",
    "backtest_predictors": f"""WITH {PTS}, {CELLS}, r AS (SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(a + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS end_, a, a + INTERVAL 7 DAY AS b FROM (SELECT unnest([TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-22']) AS a)),
      naive AS (SELECT start, {CELL}, count(*)::DOUBLE AS w FROM pts JOIN r ON ts < a GROUP BY ALL),
      retro AS (SELECT start, gx, gy, sum(pow(1 - {D2} / 40000, 2)) AS w FROM r JOIN pts ON ts < a AND ts >= a - INTERVAL 60 DAY JOIN cells ON {D2} <= 40000 GROUP BY ALL),
      aged AS (SELECT start, {CELL}, (epoch_us(a) - epoch_us(ts)) // 86400000000 AS age FROM pts JOIN r ON ts < a),
      pro AS (SELECT start, c.gx, c.gy, sum(1 / ((1 + greatest(abs(c.gx - e.gx), abs(c.gy - e.gy))::DOUBLE) * (1 + age::DOUBLE))) AS w FROM cells c JOIN aged e ON abs(c.gx - e.gx) < 8 AND abs(c.gy - e.gy) < 8 AND age < 8 GROUP BY ALL),
      every AS (SELECT 'naive' AS predictor, * FROM naive UNION ALL SELECT 'retro', * FROM retro UNION ALL SELECT 'prospective', * FROM pro),
      hit AS (SELECT start, {CELL}, count(*) AS count FROM pts JOIN r ON ts >= a AND ts < b GROUP BY ALL), total AS (SELECT start, sum(count) AS total FROM hit GROUP BY start),
      k AS (SELECT p.predictor, r.start, r.end_, coalesce(count, 0) AS count, row_number() OVER (PARTITION BY p.predictor, r.start ORDER BY coalesce(w, 0) DESC, cells.gy DESC, cells.gx DESC) AS rank
        FROM (SELECT unnest(['naive', 'retro', 'prospective']) AS predictor) p CROSS JOIN r CROSS JOIN cells LEFT JOIN every USING (predictor, start, gx, gy) LEFT JOIN hit USING (start, gx, gy))
      SELECT predictor, start, end_ AS "end", coverage, CAST(sum(count) FILTER (rank <= floor(660 * (coverage / 100.0::DOUBLE))) AS BIGINT) AS hits, CAST(any_value(total) AS BIGINT) AS total,
        round(sum(count) FILTER (rank <= floor(660 * (coverage / 100.0::DOUBLE))) / any_value(total), 6) AS rate FROM k JOIN total USING (start), (SELECT unnest([10, 20])::INTEGER AS coverage) GROUP BY predictor, start, end_, coverage""",
    "hotspot_backtest": f"WITH {BACKTEST} SELECT * FROM bt",
    "backtest_pivot": f"""WITH {BACKTEST} SELECT 'naive' AS predictor, start, "end", total, max(hits) FILTER (coverage = 1) AS "1%", max(hits) FILTER (coverage = 5) AS "5%",
      max(hits) FILTER (coverage = 10) AS "10%", max(hits) FILTER (coverage = 20) AS "20%", max(hits) FILTER (coverage = 50) AS "50%" FROM bt GROUP BY start, "end", total""",
    "beta_posterior": f"""WITH {BACKTEST}, s AS (SELECT coverage, CAST(sum(hits) AS BIGINT) AS a, CAST(sum(total - hits) AS BIGINT) AS b FROM bt GROUP BY coverage)
      SELECT coverage, a, b, round(a / (a + b), 6) AS mean, round(sqrt(a * b / ((a + b)::DOUBLE * (a + b) * (a + b + 1))), 6) AS sd FROM s""",
    "points_events_before": f"WITH {PTS} SELECT event_id, x, y FROM pts WHERE ts <= TIMESTAMP '2024-01-10 12:00:00'",
    "points_bbox": f"WITH {PTS} SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM pts",
    "points_time_deltas": f"WITH {PTS} SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM pts)) / 60000000.0::DOUBLE AS t, x, y FROM pts",
    "points_bin_timestamps": f"WITH {PTS} SELECT make_timestamp(CAST(epoch_us(TIMESTAMP '2024-01-05 06:00:00') + floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-05 06:00:00')) / 86400000000.0::DOUBLE) * 86400000000 AS BIGINT)) AS ts, count(*) AS n FROM pts GROUP BY 1",
    "points_type_counts": f"WITH {PTS} SELECT category, count(*) AS n, row_number() OVER (ORDER BY category) - 1 AS code FROM pts GROUP BY category",
    "points_train": f"WITH {PTS} SELECT event_id FROM pts WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-22' AND category IN ('click', 'error')",
    "points_assess": f"WITH {PTS} SELECT event_id FROM pts WHERE ts > TIMESTAMP '2024-01-22' AND ts <= TIMESTAMP '2024-01-29' AND category IN ('click', 'error')",
    "points_default_split": f"""WITH {PTS}, m AS (SELECT epoch_us(min(ts)) // 60000000 * 60000000 AS a, epoch_us(max(ts)) // 60000000 * 60000000 AS b FROM pts)
      SELECT make_timestamp(a) AS train_start, make_timestamp(least(((a + b) // 2) // 60000000 * 60000000, a + 365 * 86400000000)) AS train_end, make_timestamp(b) AS assess_end FROM m""",
    "project_lonlat": f"""WITH {PTS}, q AS (SELECT event_id, x / 100000 + -1.5::DOUBLE AS x, y / 100000 + 51.0::DOUBLE AS y FROM pts), m AS (SELECT avg(y) * (pi() / 180) AS phi FROM q)
      SELECT event_id, round(x * (111412.84::DOUBLE * cos(phi) - 93.5::DOUBLE * cos(3 * phi)), 3) AS x, round(y * (111132.92::DOUBLE - 559.82::DOUBLE * cos(2 * phi) + 1.175::DOUBLE * cos(4 * phi)), 3) AS y FROM q, m""",
    "grid_coord": f"WITH {PTS} SELECT event_id, {CELL} FROM pts",
    "grid_snap_centre": f"WITH {PTS} SELECT event_id, (floor((x - 20) / 250) + 0.5::DOUBLE) * 250 + 20 AS x, (floor((y - 30) / 250) + 0.5::DOUBLE) * 250 + 30 AS y FROM pts",
    "grid_mask_points": f"WITH {PTS}, {CELLS} SELECT DISTINCT gx, gy FROM cells JOIN pts ON x >= gx * 150 AND x <= (gx + 1) * 150 AND y >= gy * 150 AND y <= (gy + 1) * 150",
    "points_in_polygon": f"WITH {PTS}, {POLY} SELECT event_id FROM pts JOIN poly ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY event_id HAVING count(*) % 2 = 1",
    "project_point_to_segments": f"WITH {PTS}, {SEGMENTS}, {NEAREST.format(p='pts', s='s', r=300)} SELECT event_id, CAST(segment_id AS BIGINT) AS segment_id, round(t, 6) AS t, round(sqrt(d2), 6) AS distance FROM k WHERE k = 1",
    "segment_grid_split": f"WITH {CELLS}, {STREETS}, {STREET_PARTS} SELECT edge_id AS segment_id, gx, gy, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM part",
    "naive_count_grid": f"WITH {PTS}, {TRAIN}, {CELLS}, {COUNTS} SELECT gx, gy, coalesce(n, 0)::DOUBLE AS risk FROM cells LEFT JOIN counts USING (gx, gy)",
    "retro_grid_quartic": weighed(f"pow(1 - {D2} / 40000, 2)", f"{D2} <= 40000"),
    "retro_grid_gauss": weighed(f"exp(-{D2} / 90000 * 9 / 2)", f"{D2} <= 90000"),
    "retro_cts_subgrid": subgrid(f"pow(1 - {D2} / 40000, 2)", f"{D2} <= 40000"),
    "prospective_grid_same": prospective("greatest(abs(c.gx - e.gx), abs(c.gy - e.gy))::DOUBLE"),
    "prospective_grid_diff": prospective("(abs(c.gx - e.gx) + abs(c.gy - e.gy))::DOUBLE"),
    "prospective_grid_circle": prospective("sqrt((c.gx - e.gx) * (c.gx - e.gx) + (c.gy - e.gy) * (c.gy - e.gy))"),
    "prospective_cts_subgrid": subgrid(f"1 / ((1 + sqrt({D2}) / 150) * (1 + age))", f"sqrt({D2}) / 150 < 3 AND age >= 0 AND age < 8"),
    "kde_gaussian_scott": kde("1.0::DOUBLE", SCOTT),
    "kde_fixed": kde("1.0::DOUBLE", FIXED.format(h=120)),
    "kde_time_exp": kde("exp(-age / 5) / 5", FIXED.format(h=200)),
    "kde_time_quad": kde("2 / (pi() * 5) / (1 + (age / 5) * (age / 5))", SCOTT),
    "kde_edge_corrected": f"WITH {PTS}, {TRAIN}, {CELLS}, {OK_CELLS}, {edge_corrected('train', 200)} SELECT gx, gy, round(risk, 12) AS risk FROM corrected",
    "knn_distance": f"""WITH {PTS}, d AS (SELECT a.event_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS k
      FROM pts a JOIN pts b ON a.event_id <> b.event_id AND abs(a.x - b.x) <= 600 AND abs(a.y - b.y) <= 600),
      far AS (SELECT event_id FROM pts EXCEPT SELECT event_id FROM d WHERE k = 15 AND d <= 600),
      e AS (SELECT a.event_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS k
      FROM (SELECT * FROM pts SEMI JOIN far USING (event_id)) a JOIN pts b ON a.event_id <> b.event_id)
      SELECT event_id, round(d, 6) AS distance FROM d WHERE k = 15 AND d <= 600 UNION ALL SELECT event_id, round(d, 6) AS distance FROM e WHERE k = 15""",
    "surface_renormalise": f"WITH {PTS}, {BASE}, {PROB} SELECT gx, gy, round(risk, 9) AS risk FROM prob",
    "surface_percentile": f"WITH {PTS}, {BASE} SELECT gx, gy, round(cume_dist() OVER (ORDER BY risk), 6) AS percentile FROM base",
    "surface_new_extent": f"WITH {PTS}, {BASE} SELECT a.range AS gx, b.range AS gy, coalesce(risk, 0) AS risk FROM range(30) a CROSS JOIN range(22) b LEFT JOIN base ON base.gx = a.range - 2 AND base.gy = b.range + 3",
    "surface_mask": f"""WITH {PTS}, {BASE}, m AS (SELECT DISTINCT gx, gy FROM cells JOIN nxt ON x >= gx * 150 AND x <= (gx + 1) * 150 AND y >= gy * 150 AND y <= (gy + 1) * 150)
      SELECT gx, gy, risk, m.gx IS NOT NULL AS valid FROM base LEFT JOIN m USING (gx, gy)""",
    "surface_zero_to_constant": f"""WITH {PTS}, {CELLS}, n AS (SELECT {CELL}, count(*) AS n FROM pts WHERE category = 'error' GROUP BY ALL), r AS (SELECT gx, gy, coalesce(n, 0)::DOUBLE AS risk FROM cells LEFT JOIN n USING (gx, gy))
      SELECT gx, gy, CASE WHEN sum(risk) OVER () > 0 THEN risk ELSE 1 END AS risk FROM r""",
    "top_slice": f"WITH {PTS}, {BASE} SELECT gx, gy, risk FROM base QUALIFY row_number() OVER (ORDER BY risk DESC, gy DESC, gx DESC) <= 66",
    "hit_counts": f"""WITH {PTS}, {BASE}, h AS (SELECT {CELL}, count(*) AS count FROM nxt GROUP BY ALL),
      k AS (SELECT coalesce(count, 0) AS count, row_number() OVER (ORDER BY risk DESC, gy DESC, gx DESC) AS rank FROM base LEFT JOIN h USING (gx, gy))
      SELECT coverage, CAST(coalesce(sum(count) FILTER (rank <= floor(660 * (coverage / 100.0::DOUBLE))), 0) AS BIGINT) AS hits, (SELECT count(*) FROM nxt) AS total FROM k, {LEVELS} GROUP BY coverage""",
    "hit_rate": f"""WITH {PTS}, {BASE}, h AS (SELECT {CELL}, count(*) AS count FROM nxt GROUP BY ALL),
      k AS (SELECT coalesce(count, 0) AS count, row_number() OVER (ORDER BY risk DESC, gy DESC, gx DESC) AS rank FROM base LEFT JOIN h USING (gx, gy))
      SELECT coverage, round(coalesce(sum(count) FILTER (rank <= floor(660 * (coverage / 100.0::DOUBLE))), 0) / (SELECT count(*) FROM nxt), 6) AS rate FROM k, {LEVELS} GROUP BY coverage""",
    "max_hit_rate": f"""WITH {PTS}, {CELLS}, {NEXT}, {SCORE}, {HITS}, k AS (SELECT coalesce(count, 0) AS count, row_number() OVER (ORDER BY coalesce(count, 0) DESC) AS rank FROM cells LEFT JOIN hits USING (gx, gy))
      SELECT coverage, round(sum(count) FILTER (rank <= floor(660 * (coverage / 100.0::DOUBLE))) / sum(count), 6) AS rate FROM k, {LEVELS} GROUP BY coverage""",
    "inverse_hit_rate": f"""WITH {PTS}, {BASE}, {SCORE}, {HITS}, l AS (SELECT risk, count(*) AS c, sum(coalesce(count, 0)) AS h FROM base LEFT JOIN hits USING (gx, gy) GROUP BY risk),
      r AS (SELECT h, sum(h) OVER (ORDER BY risk DESC) AS hh, sum(c) OVER (ORDER BY risk DESC) AS cc FROM l)
      SELECT round(hh * 100 / (SELECT count(*) FROM score)::DOUBLE, 6) AS hit_percent, round(cc * 100 / 660.0::DOUBLE, 6) AS coverage_percent FROM r WHERE h > 0""",
    "likelihood": f"{SCORED} SELECT round(avg(ln(CASE WHEN p.risk > 0 THEN p.risk ELSE 1e-9 END)), 6) AS likelihood FROM score s JOIN prob p USING (gx, gy)",
    "brier": f"{SCORED} SELECT round(sum((u - p) * (u - p)) / (660 * 22500.0::DOUBLE), 12) AS brier, round(2 * sum(p * u) / (sum(u * u) + sum(p * p)), 12) AS skill FROM f",
    "kl": f"{SCORED} SELECT round(sum({KLS}) / (660 * 22500.0::DOUBLE), 12) AS kl FROM f",
    "multiscale_brier": f"""{SCORED}, m AS (SELECT c.gx, c.gy, sum(u) AS u0, sum(p) AS p0, count(*)::DOUBLE AS c0 FROM cells c JOIN f ON f.gx BETWEEN c.gx AND c.gx + 2 AND f.gy BETWEEN c.gy AND c.gy + 2 WHERE c.gx <= 30 AND c.gy <= 17 GROUP BY ALL),
      n AS (SELECT u0 / sum(u0) OVER () AS u, p0 / sum(p0) OVER () AS p, c0 / sum(c0) OVER () AS c FROM m)
      SELECT round(sum(c * (u - p) * (u - p)) / 22500.0::DOUBLE, 12) AS brier, round(2 * sum(c * u * p) / sum(c * (u * u + p * p)), 12) AS skill FROM n""",
    "multiscale_kl": f"""{SCORED}, m AS (SELECT c.gx, c.gy, sum(u) AS u0, sum(p) AS p0, count(*)::DOUBLE AS c0 FROM cells c JOIN f ON f.gx BETWEEN c.gx AND c.gx + 2 AND f.gy BETWEEN c.gy AND c.gy + 2 WHERE c.gx <= 30 AND c.gy <= 17 GROUP BY ALL),
      n AS (SELECT u0 / sum(u0) OVER () AS u, p0 / sum(p0) OVER () AS p, c0 / sum(c0) OVER () AS c FROM m) SELECT round(sum(c * {KLS}) / 22500.0::DOUBLE, 12) AS kl FROM n""",
    "ranking": f"{SCORED}, r AS (SELECT gx, gy, cume_dist() OVER (ORDER BY risk) AS c FROM prob) SELECT event_id, round(c, 6) AS percentile FROM score JOIN r USING (gx, gy)",
    "bayes_predictive": f"{SCORED}, a AS (SELECT count, CASE WHEN p <= 0 THEN 1e-10 ELSE p * 10 END AS al, sum(count) OVER () AS n FROM f), w AS (SELECT *, (al + count) / (10 + n) AS w FROM a) SELECT round(sum(w * (ln(w) + ln(10) - ln(al))), 6) AS score FROM w",
    "poisson_crps": f"""{SCORED}, c AS (SELECT gx, gy, count, p * sum(count) OVER () AS mean FROM f),
      e AS (SELECT *, unnest(range(0, CAST(ceil(greatest(count, mean) + 10 * sqrt(greatest(count, mean)) + 30) AS BIGINT) + 1)) AS k FROM c),
      k AS (SELECT gx, gy, count, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY gx, gy ORDER BY k) AS cdf FROM e)
      SELECT round(sum(CASE WHEN k < count THEN cdf * cdf ELSE (1 - cdf) * (1 - cdf) END), 3) AS crps FROM k""",
    "knox_statistic": f"""WITH {PTS}, p AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS dt FROM pts a JOIN pts b ON a.event_id < b.event_id AND abs(a.x - b.x) <= 100 AND abs(a.y - b.y) <= 100),
      s(space_bin, s0, s1) AS (VALUES (0, 0, 50), (1, 50, 100), (2, 0, 100)), t(time_bin, t0, t1) AS (VALUES (0, 0, 86400000000), (1, 86400000000, 259200000000), (2, 0, 604800000000))
      SELECT space_bin::INTEGER AS space_bin, time_bin::INTEGER AS time_bin, count(d) AS statistic FROM s CROSS JOIN t LEFT JOIN p ON d BETWEEN s0 AND s1 AND dt BETWEEN t0 AND t1 GROUP BY ALL""",
    "seppexp_p_matrix": f"""WITH {SEPP} SELECT j, round(sum(p) FILTER (i = j), 6) AS background, count(*) FILTER (i <> j) AS triggers, round(coalesce(sum(p) FILTER (i <> j), 0), 6) AS triggered,
      coalesce(arg_min(i, {{'dt': dt, 'i': i}}) FILTER (i <> j), -1) AS latest FROM pm GROUP BY j""",
    "seppexp_em_1": f"""WITH {SEPP}, o AS (SELECT sum(p) AS s, sum(p * dt) AS st FROM pm WHERE i <> j)
      SELECT gx, gy, round(sum(p) / 30240.0::DOUBLE, 9) AS mu, round(any_value(s / st), 9) AS omega, round(any_value(s) / (SELECT count(*) FROM ev), 9) AS theta FROM pm, o WHERE i = j GROUP BY gx, gy""",
    "seppexp_predict": f"""WITH {SEPP}, tr AS (SELECT gx, gy, sum(0.5::DOUBLE * (1 / 1440.0::DOUBLE) * exp(-(1 / 1440.0::DOUBLE) * ((epoch_us(TIMESTAMP '2024-01-22') - (SELECT min(epoch_us(ts)) FROM week)) / 60000000.0::DOUBLE - t))) AS r FROM ev GROUP BY ALL),
      c AS (SELECT a.range AS gx, b.range AS gy FROM range(4) a, range(3) b) SELECT gx, gy, round(coalesce(mu, 0) + coalesce(r, 0), 9) AS risk FROM c LEFT JOIN mu USING (gx, gy) LEFT JOIN tr USING (gx, gy)""",
    "sepp_initial_p": f"""WITH {PTS}, raw AS (SELECT event_id AS i, event_id AS j, 1.0::DOUBLE AS p FROM pts UNION ALL
      SELECT a.event_id, b.event_id, exp(-((epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000.0::DOUBLE) / 0.1::DOUBLE) * exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 5000) FROM pts a JOIN pts b
      ON (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND epoch_us(b.ts) - epoch_us(a.ts) <= 172800000000 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 10000)
      SELECT i, j, round(p / sum(p) OVER (PARTITION BY j), 6) AS p FROM raw""",
    "graph_degree": f"WITH {STREETS} SELECT * FROM deg",
    "graph_derived": f"WITH {STREETS} SELECT DISTINCT s.edge_id AS e1, t.edge_id AS e2, (s.length + t.length) / 2 AS length FROM both_ways s JOIN both_ways t ON s.a = t.a AND s.edge_id < t.edge_id",
    "graph_components": f"""WITH RECURSIVE {STREETS}, b AS (SELECT a, b FROM both_ways WHERE edge_id % 3 <> 1), r AS (SELECT DISTINCT a AS key, a AS c FROM b UNION SELECT b.b, r.c FROM r JOIN b ON r.key = b.a)
      SELECT key, min(c) AS component FROM r GROUP BY key""",
    "graph_shortest_paths": f"""WITH RECURSIVE {STREETS}, r AS (SELECT k2 AS key, 0 AS steps FROM own UNION SELECT b.b, r.steps + 1 FROM r JOIN both_ways b ON r.key = b.a WHERE steps < 150),
      m AS (SELECT key, min(steps) * 150.0::DOUBLE AS d FROM r GROUP BY key) SELECT deg.key, coalesce(d, -1) AS distance FROM deg LEFT JOIN m USING (key)""",
    "graph_simple_paths": f"""WITH RECURSIVE {STREETS}, r AS (SELECT [k2] AS path, k2 AS at, 0.0::DOUBLE AS length FROM own UNION ALL
      SELECT list_append(path, b.b), b.b, r.length + b.length FROM r JOIN both_ways b ON r.at = b.a WHERE NOT list_contains(path, b.b) AND r.length + b.length <= 750 AND len(path) <= 5)
      SELECT array_to_string(path, ',') AS path, length FROM r""",
    "graph_walk_degrees": f"""WITH RECURSIVE {STREETS}, w AS (SELECT b.*, greatest(degree - 1, 1)::DOUBLE AS split FROM both_ways b JOIN deg ON deg.key = b.a),
      r AS (SELECT k1, k2, [k1, k2] AS path, 0.0::DOUBLE AS enter, 0.0::DOUBLE AS leave, 1.0::DOUBLE AS degree FROM own UNION ALL
      SELECT w.a, w.b, list_append(path, w.b), r.leave, r.leave + w.length, r.degree * split FROM r JOIN w ON r.k2 = w.a WHERE NOT list_contains(path, w.b) AND r.degree * split <= 50 AND r.leave < 600)
      SELECT k1, k2, enter AS length, degree FROM r WHERE len(path) > 2""",
    "graph_ordered_segments": f"""WITH RECURSIVE {STREETS}, two AS (SELECT s.edge_id AS e, t.edge_id AS f FROM both_ways s JOIN both_ways t ON s.a = t.a AND s.edge_id <> t.edge_id JOIN deg ON deg.key = s.a AND degree = 2),
      r AS (SELECT edge_id, edge_id AS c FROM edges UNION SELECT f, c FROM r JOIN two ON r.edge_id = two.e), seg AS (SELECT edge_id, min(c) AS segment FROM r GROUP BY edge_id),
      ends AS (SELECT key FROM deg WHERE degree <> 2 UNION SELECT min(a) FROM both_ways JOIN seg USING (edge_id) JOIN deg ON key = a GROUP BY segment HAVING count(*) FILTER (degree <> 2) = 0),
      walk AS (SELECT edge_id, a, b, a AS s, edge_id AS f, 0 AS place FROM both_ways JOIN ends ON key = a
        UNION ALL SELECT n.edge_id, n.a, n.b, w.s, w.f, w.place + 1 FROM walk w JOIN both_ways n ON n.a = w.b AND n.edge_id <> w.edge_id WHERE w.b NOT IN (SELECT key FROM ends))
      SELECT edge_id, segment, place, a AS k_from, b AS k_to FROM walk JOIN seg USING (edge_id) QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY s, f, place, a) = 1""",
    "graph_split_edges": f"""WITH {STREETS} SELECT edge_id, range::INTEGER AS part, a.x + (b.x - a.x) * range / 3 AS x1, a.y + (b.y - a.y) * range / 3 AS y1, a.x + (b.x - a.x) * (range + 1) / 3 AS x2, a.y + (b.y - a.y) * (range + 1) / 3 AS y2, length / 3 AS length
      FROM edges e JOIN v a ON a.key = k1 JOIN v b ON b.key = k2, range(3)""",
    "graph_segments": f"""WITH RECURSIVE {STREETS}, two AS (SELECT s.edge_id AS e, t.edge_id AS f FROM both_ways s JOIN both_ways t ON s.a = t.a AND s.edge_id <> t.edge_id JOIN deg ON deg.key = s.a AND degree = 2),
      r AS (SELECT edge_id, edge_id AS c FROM edges UNION SELECT f, c FROM r JOIN two ON r.edge_id = two.e) SELECT edge_id, min(c) AS segment FROM r GROUP BY edge_id""",
    "network_project": f"WITH {STREET_EVENTS} SELECT event_id, edge_id, round(t, 6) AS t FROM ev",
    "network_hotspot": f"""WITH RECURSIVE {STREET_EVENTS}, w AS (SELECT b.*, greatest(degree - 1, 1) AS split FROM both_ways b JOIN deg ON deg.key = b.a),
      st AS (SELECT e.*, k1, k2, length FROM ev e JOIN edges USING (edge_id)),
      r AS (SELECT edge_id AS edge, [k1, k2] AS path, k2 AS at, 0.0::DOUBLE AS d0, length * (1 - t) AS d, 1.0::DOUBLE AS w FROM st UNION ALL SELECT edge_id, [k2, k1], k1, 0.0::DOUBLE, length * t, 1.0::DOUBLE FROM st
        UNION ALL SELECT w.edge_id, list_append(path, w.b), w.b, r.d, r.d + w.length, r.w / split FROM r JOIN w ON r.at = w.a WHERE NOT list_contains(path, w.b) AND r.d < 320),
      z AS (SELECT edge AS edge_id, sum(w * {TRI.format(a='d0', b='d')}) AS v FROM r GROUP BY edge)
      SELECT edge_id, round(coalesce(v, 0) / length, 6) AS risk FROM edges LEFT JOIN z USING (edge_id)""",
    "network_coverage": f"WITH {STREET_EVENTS}, {NET_COVER} SELECT * FROM cover",
    "network_hit_counts": f"""WITH {STREET_EVENTS}, {NET_COVER}, z AS (SELECT upto, total, coalesce(n, 0) AS n FROM run LEFT JOIN (SELECT edge_id, count(*) AS n FROM ev GROUP BY edge_id) USING (edge_id))
      SELECT coverage, CAST(coalesce(sum(n) FILTER (upto <= total * (coverage / 100.0::DOUBLE)), 0) AS BIGINT) AS hits, (SELECT count(*) FROM ev) AS total,
        round(coalesce(sum(n) FILTER (upto <= total * (coverage / 100.0::DOUBLE)), 0) * 100 / (SELECT count(*) FROM ev), 6) AS rate FROM z, (SELECT unnest([10, 20, 50])::INTEGER AS coverage) GROUP BY coverage""",
    "network_hit_rate": f"WITH {STREET_EVENTS}, {NET_COVER} SELECT count(cover.edge_id) AS hits, count(*) AS total, round(count(cover.edge_id) / count(*), 6) AS rate FROM ev LEFT JOIN cover USING (edge_id)",
}
ORACLE["network_hotspot_indexed"] = ORACLE["network_hotspot"]

RINGS = f"""WITH {PTS},
 c AS (SELECT 1000 * gy + gx AS region_id, [l.x, b.x, r.x, t.x] AS xs, [l.y, b.y, r.y, t.y] AS ys FROM
   (SELECT CAST(floor(x / 750) AS BIGINT) AS gx, CAST(floor(y / 750) AS BIGINT) AS gy, min({{'x': x, 'e': event_id, 'y': y}}) AS l, min({{'y': y, 'e': event_id, 'x': x}}) AS b,
     max({{'x': x, 'e': event_id, 'y': y}}) AS r, max({{'y': y, 'e': event_id, 'x': x}}) AS t FROM pts GROUP BY ALL)),
 m AS (SELECT *, (xs[1] + xs[2] + xs[3] + xs[4]) / 4 AS mx, (ys[1] + ys[2] + ys[3] + ys[4]) / 4 AS my FROM c),
 rings AS (SELECT region_id, xs, ys FROM m UNION ALL SELECT region_id, list_transform(xs, lambda v: (v + mx) / 2), list_transform(ys, lambda v: (v + my) / 2) FROM m),
 edges AS (SELECT region_id, xs[i] AS x1, ys[i] AS y1, xs[i % 4 + 1] AS x2, ys[i % 4 + 1] AS y2 FROM rings, (SELECT unnest([1, 2, 3, 4]) AS i))"""
LIES = """(count(*) FILTER (y1 <> y2 AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 OR
   count(*) FILTER ((x1 <> x2 OR y1 <> y2) AND (x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) > 0)"""
CLOUD = """(SELECT s.*, h * sqrt(-2 * ln(1 - (i.range + 0.5::DOUBLE) / 10)) AS r, a.range * (2 * pi() / 100) AS phi, i.range AS i, a.range AS a FROM {source} s, range(10) i, range(100) a)"""
ROOT = """root AS (SELECT *, sqrt(sxx * syy - sxy * sxy) AS det, sqrt(sxx + syy + 2 * sqrt(sxx * syy - sxy * sxy)) AS t FROM
   (SELECT var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy, pow(count(*), -1 / 6.0::DOUBLE) AS h FROM {events}))"""
MOVED = "{x} + (sxx + det) / t * r * cos(phi) + sxy / t * r * sin(phi) AS x, {y} + sxy / t * r * cos(phi) + (syy + det) / t * r * sin(phi) AS y"
ORACLE |= {
    "points_split_counts": f"""WITH {PTS} SELECT count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-22') AS train_count,
      count(*) FILTER (ts > TIMESTAMP '2024-01-22' AND ts <= TIMESTAMP '2024-01-29') AS assess_count FROM pts""",
    "grid_over_points": f"""WITH {PTS}, b AS (SELECT CAST(floor((min(x) - 35) / 130) AS BIGINT) AS x0, CAST(floor((max(x) - 35) / 130) AS BIGINT) AS x1,
      CAST(floor((min(y) + 20) / 170) AS BIGINT) AS y0, CAST(floor((max(y) + 20) / 170) AS BIGINT) AS y1 FROM pts)
      SELECT i * 130.0::DOUBLE + 35 AS x, j * 170.0::DOUBLE - 20 AS y FROM (SELECT unnest(range(x0, x1 + 1)) AS i FROM b), (SELECT unnest(range(y0, y1 + 1)) AS j FROM b)""",
    "points_in_regions": f"{RINGS} SELECT event_id, region_id FROM pts, edges GROUP BY event_id, region_id HAVING {LIES}",
    "region_edge_factors": f"""{RINGS}, {ROOT.format(events="pts")},
      cells AS (SELECT gx, gy, (gx + 0.5::DOUBLE) * 150 AS x, (gy + 0.5::DOUBLE) * 150 AS y FROM (SELECT DISTINCT {CELL} FROM pts) WHERE gx BETWEEN 0 AND 32 AND gy BETWEEN 0 AND 19),
      inside AS (SELECT gx, gy, region_id, any_value(x) AS cx, any_value(y) AS cy FROM cells, edges GROUP BY gx, gy, region_id HAVING {LIES}),
      cloud AS (SELECT gx, gy, region_id, i, a, {MOVED.format(x="cx", y="cy")} FROM {CLOUD.format(source="(SELECT * FROM inside, root)")}),
      hits AS (SELECT gx, gy, region_id, i, a FROM cloud JOIN edges USING (region_id) GROUP BY ALL HAVING {LIES})
      SELECT gx, gy, region_id, round(coalesce(n, 0) / 1000.0::DOUBLE, 6) AS factor FROM inside LEFT JOIN (SELECT gx, gy, region_id, count(*) AS n FROM hits GROUP BY ALL) USING (gx, gy, region_id)""",
    "kde_correlated_3d": f"""WITH {PTS}, {TRAIN}, {CELLS}, e AS (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0::DOUBLE AS t, x, y FROM train),
      s AS (SELECT var_samp(t) AS a, covar_samp(t, x) AS b, covar_samp(t, y) AS c, var_samp(x) AS d, covar_samp(x, y) AS f, var_samp(y) AS g, count(*) AS n, pow(count(*) * 5 / 4.0::DOUBLE, -1 / 7.0::DOUBLE) AS h FROM e),
      k AS (SELECT *, a * (d * g - f * f) - b * (b * g - f * c) + c * (b * f - d * c) AS det FROM s),
      w AS (SELECT gx, gy, i, mx - x AS u, my - y AS v, 3.0::DOUBLE + 6 * i - t AS z, k.* FROM cells, (SELECT unnest([0, 1, 2, 3])::INTEGER AS i), e, k)
      SELECT gx, gy, i, round(1e9::DOUBLE * sum(exp(-(z * z * (d * g - f * f) + u * u * (a * g - c * c) + v * v * (a * d - b * b) + 2 * (z * u * (c * f - b * g) + z * v * (b * f - c * d) + u * v * (b * c - a * f)))
        / det / (2 * h * h)) / (n * sqrt(det) * pow(2 * pi(), 1.5::DOUBLE) * h * h * h)), 6) AS density FROM w GROUP BY gx, gy, i""",
    "graph_from_paths": f"""WITH {PTS}, p AS (SELECT user_id AS line, event_id, e.ts, (floor(pts.x / 250) + 0.5::DOUBLE) * 250 AS x, (floor(pts.y / 250) + 0.5::DOUBLE) * 250 AS y FROM events e JOIN pts USING (event_id)),
      c AS (SELECT *, row_number() OVER (ORDER BY line, ts, event_id) AS id, row_number() OVER (PARTITION BY line ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY line) AS n FROM p),
      k AS (SELECT line, id, x, y, CASE WHEN seq = 1 OR seq = n THEN min(id) OVER (PARTITION BY x, y) ELSE id END AS key FROM c),
      s AS (SELECT id AS edge_id, key AS k1, lead(key) OVER w AS k2, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS length FROM k WINDOW w AS (PARTITION BY line ORDER BY id))
      SELECT edge_id, k1, k2, round(length, 6) AS length FROM s WHERE k2 IS NOT NULL AND k1 <> k2""",
    "kde_score_scott": f"""{SCORED}, {ROOT.format(events="score")}, {OK_CELLS},
      valid AS (SELECT gx, gy, risk / sum(risk) OVER () AS p FROM base JOIN ok USING (gx, gy)),
      places AS (SELECT gx, gy, i.range * 5 + j.range AS s, (gx + (i.range + 0.5::DOUBLE) / 5) * 150 AS x, (gy + (j.range + 0.5::DOUBLE) / 5) * 150 AS y FROM valid, range(5) i, range(5) j),
      d AS (SELECT q.gx, q.gy, q.s, sum(exp(-((q.x - e.x) * (q.x - e.x) * syy - 2 * (q.x - e.x) * (q.y - e.y) * sxy + (q.y - e.y) * (q.y - e.y) * sxx) / (det * det) / (2 * h * h))) AS v FROM places q, score e, root GROUP BY ALL),
      cloud AS (SELECT pgx, pgy, s, {MOVED.format(x="px", y="py")} FROM {CLOUD.format(source="(SELECT gx AS pgx, gy AS pgy, s, x AS px, y AS py, root.* FROM places, root)")}),
      fac AS (SELECT pgx AS gx, pgy AS gy, s, sum(k) / 1000.0::DOUBLE AS factor FROM (SELECT pgx, pgy, s, {CELL}, count(*) AS k FROM cloud GROUP BY ALL) JOIN ok USING (gx, gy) GROUP BY ALL),
      z AS (SELECT gx, gy, avg(v / factor) AS r FROM d JOIN fac USING (gx, gy, s) GROUP BY ALL), u AS (SELECT gx, gy, r / sum(r) OVER () AS q FROM z)
      SELECT round(sum(pow(p - q, 2)) * 22500, 6) AS score FROM valid JOIN u USING (gx, gy)""",
}
ORACLE |= {
    "graph_paths_between": f"""WITH RECURSIVE {STREETS}, r AS (SELECT [k1] AS path, k1 AS at, k2 AS goal, k1 AS origin, 0.0::DOUBLE AS length FROM own UNION ALL
      SELECT list_append(path, b.b), b.b, goal, origin, r.length + b.length FROM r JOIN both_ways b ON r.at = b.a
      WHERE r.at <> goal AND NOT list_contains(path, b.b) AND r.length + b.length <= 900 AND NOT (b.a = origin AND b.b = goal))
      SELECT array_to_string(path, ',') AS path, length FROM r WHERE r.at = goal""",
    "cells_meeting_regions": f"""{RINGS}, real AS (SELECT region_id, x1, y1, x2, y2 FROM edges WHERE x1 <> x2 OR y1 <> y2),
      grid AS (SELECT a.range AS gx, b.range AS gy, a.range * 150.0::DOUBLE AS l, b.range * 150.0::DOUBLE AS b, a.range * 150.0::DOUBLE + 75 AS x, b.range * 150.0::DOUBLE + 75 AS y FROM range(33) a, range(20) b),
      crossed AS (SELECT gx, gy FROM grid, real WHERE least(x1, x2) <= l + 150 AND greatest(x1, x2) >= l AND least(y1, y2) <= b + 150 AND greatest(y1, y2) >= b
        AND least((x2 - x1) * (b - y1) - (y2 - y1) * (l - x1), (x2 - x1) * (b + 150 - y1) - (y2 - y1) * (l - x1), (x2 - x1) * (b - y1) - (y2 - y1) * (l + 150 - x1), (x2 - x1) * (b + 150 - y1) - (y2 - y1) * (l + 150 - x1)) <= 0
        AND greatest((x2 - x1) * (b - y1) - (y2 - y1) * (l - x1), (x2 - x1) * (b + 150 - y1) - (y2 - y1) * (l - x1), (x2 - x1) * (b - y1) - (y2 - y1) * (l + 150 - x1), (x2 - x1) * (b + 150 - y1) - (y2 - y1) * (l + 150 - x1)) >= 0)
      SELECT gx, gy FROM crossed UNION SELECT gx, gy FROM (SELECT gx, gy, region_id FROM grid, edges GROUP BY gx, gy, region_id HAVING {LIES})""",
}
