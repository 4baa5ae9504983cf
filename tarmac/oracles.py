"""DuckDB's SQL for the queries of ``tarmac.queries``, from the same tables.

Shortest paths are recursive common table expressions over integer weights;
ordered folds are list reductions.
"""

from __future__ import annotations

import re

R = "6371000.0::DOUBLE"


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2.0::DOUBLE) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2.0::DOUBLE))"
    return f"(2 * {R} * atan2(sqrt({h}), sqrt(1 - {h})))"


def heuristic(a: str, b: str, c: str, d: str) -> str:
    dx, dy = f"(radians({d} - {b}) * cos(radians({c})))", f"radians({c} - {a})"
    return f"(sqrt({dx} * {dx} + {dy} * {dy}) * {R})"


def local_m(a: str, b: str, c: str, d: str) -> str:
    dy, dx = f"(({a} - {c}) * 111320.0::DOUBLE)", f"(({b} - {d}) * 111320.0::DOUBLE * cos(radians(({a} + {c}) * 0.5::DOUBLE)))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def px(lon: str) -> str:
    return f"(radians({lon}) * cos(radians(31.5::DOUBLE)) * {R})"


def py(lat: str) -> str:
    return f"(radians({lat}) * {R})"


def along(x: str, y: str, ax: str, ay: str, bx: str, by: str) -> str:
    sq = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    return f"CASE WHEN {sq} > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({x} - {ax}) * ({bx} - {ax}) + ({y} - {ay}) * ({by} - {ay})) / {sq})) ELSE 0.0::DOUBLE END"


def segment(x: str, y: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = f"({along(x, y, ax, ay, bx, by)})"
    qx, qy = f"({x} - ({ax} + {t} * ({bx} - {ax})))", f"({y} - ({ay} + {t} * ({by} - {ay})))"
    return f"sqrt({qx} * {qx} + {qy} * {qy})"


def fold(rows: str) -> str:
    """EWMA over ordered structs; ``rows`` is the list expression."""
    return f"list_reduce(list_prepend({{'w': 1.0::DOUBLE, 'ratio': 0.0::DOUBLE, 'alpha': 0.0::DOUBLE}}, {rows}), lambda a, x: {{'w': greatest(1.0::DOUBLE, x.alpha * greatest(1.0::DOUBLE, x.ratio) + (1 - x.alpha) * a.w), 'ratio': x.ratio, 'alpha': x.alpha}}).w"


SAMPLES = "list({'w': 1.0::DOUBLE, 'ratio': ratio, 'alpha': alpha} ORDER BY us, event_id)"
LEVELS = "list_reduce(list_prepend(0::BIGINT, list(delta ORDER BY us, event_id)), lambda a, x: greatest(0::BIGINT, a + x))"
CLASS = "CASE highway WHEN 'primary' THEN 3 WHEN 'secondary' THEN 4 WHEN 'tertiary' THEN 5 WHEN 'residential' THEN 6 END"
SPEED_TAG = "coalesce(try_cast(regexp_extract(maxspeed, '^[0-9.]+') AS DOUBLE), 0)"
DEFAULT = f"CASE {CLASS} WHEN 3 THEN 80.0::DOUBLE WHEN 4 THEN 60.0::DOUBLE ELSE 50.0::DOUBLE END"
FORWARD = "lower(trim(coalesce(oneway, ''))) IN ('yes', 'true', '1')"
BACKWARD = "lower(trim(coalesce(oneway, ''))) IN ('-1', 'reverse')"
ONE_WAY = f"({FORWARD} OR {BACKWARD} OR (lower(trim(coalesce(oneway, ''))) NOT IN ('no', 'false', '0') AND lower(coalesce(junction, '')) = 'roundabout'))"

#: Name -> body; each may use those before it.
VIEWS = {
    "n": "SELECT count(*) AS n FROM part",
    "nodes": "SELECT p_partkey AS id, p_size::BIGINT AS size, p_partkey // 50 AS r, p_partkey % 50 AS c, 32.0::DOUBLE + (p_partkey // 50) * 0.001::DOUBLE AS lat, 34.0::DOUBLE + (p_partkey % 50) * 0.001::DOUBLE AS lon, (p_partkey // 500) * 5 + (p_partkey % 50) // 10 AS cell FROM part",
    "raw_ways": """SELECT id * 2 AS way_id, id AS a, id + 1 AS b, CASE WHEN (r + c) % 3 = 0 THEN 'primary' ELSE 'secondary' END AS highway,
        CASE WHEN size % 16 = 0 THEN '-1' WHEN size % 8 = 0 THEN ' Yes' ELSE 'no' END AS oneway, CASE WHEN size % 10 <> 7 THEN (35 + (r + c) % 4 * 10)::VARCHAR END AS maxspeed, NULL::VARCHAR AS junction FROM nodes, n WHERE c < 49 AND id + 1 < n
      UNION ALL SELECT id * 2 + 1, id, id + 50, CASE WHEN (r + c) % 2 = 0 THEN 'residential' ELSE 'tertiary' END,
        CASE WHEN size % 18 = 0 THEN 'reverse' WHEN size % 9 = 0 THEN '1' END, CASE WHEN size % 10 <> 3 THEN (30 + (2 * r + c) % 4 * 8)::VARCHAR || ' km/h' END, CASE WHEN size % 25 = 0 THEN 'Roundabout' END FROM nodes, n WHERE id + 50 < n""",
    "ways": f"SELECT way_id, a, b, {CLASS} AS road_class, CASE WHEN {SPEED_TAG} > 0 THEN {SPEED_TAG} ELSE {DEFAULT} END AS speed_kmh, {ONE_WAY} AS is_one_way, {BACKWARD} AS is_reverse FROM raw_ways",
    "ends": "SELECT way_id, a AS src, b AS dst, road_class, speed_kmh, is_one_way FROM ways WHERE NOT (is_one_way AND is_reverse) UNION ALL SELECT way_id, b, a, road_class, speed_kmh, is_one_way FROM ways WHERE NOT is_one_way OR is_reverse",
    "measured": f"SELECT e.*, s.cell AS cell_src, d.cell AS cell_dst, s.lat AS lat1, s.lon AS lon1, d.lat AS lat2, d.lon AS lon2, round({haversine('s.lat', 's.lon', 'd.lat', 'd.lon')}, 3) AS length_m FROM ends e JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst",
    "edges": "SELECT *, row_number() OVER (ORDER BY src, dst, way_id) - 1 AS edge_id, round(length_m / (speed_kmh / 3.6::DOUBLE), 6) AS base_weight, round(round(length_m / (speed_kmh / 3.6::DOUBLE), 6) * 100)::BIGINT AS wt FROM measured",
    "ev": """SELECT x.event_id, epoch_us(ts) AS us, user_id, event_type, value, e.edge_id, e.length_m, e.base_weight, e.speed_kmh,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 0.5::DOUBLE + value / 50 WHEN event_type IN ('click', 'view') AND value > 0 THEN e.length_m / (value / 3.6::DOUBLE) / e.base_weight ELSE -1.0::DOUBLE END AS ratio,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 0.15::DOUBLE ELSE 0.08::DOUBLE END AS alpha,
        CASE event_type WHEN 'click' THEN 1::BIGINT WHEN 'view' THEN -1::BIGINT END AS delta
      FROM events x, n JOIN edges e ON e.edge_id = (x.user_id * 7 + x.event_id % 3) % n.n""",
    "mult": f"SELECT edge_id, {fold(SAMPLES)} AS weight, count(*) AS samples FROM ev WHERE ratio > 0 GROUP BY edge_id",
    "dens": f"SELECT edge_id, {LEVELS} AS density FROM ev WHERE delta IS NOT NULL GROUP BY edge_id",
    "state": "SELECT edge_id, coalesce(m.weight, 1.0::DOUBLE) AS weight, coalesce(d.density, 0) AS density FROM mult m FULL JOIN dens d USING (edge_id)",
    "live": "SELECT e.*, coalesce(s.weight, 1.0::DOUBLE) AS multiplier, e.base_weight * coalesce(s.weight, 1.0::DOUBLE) AS live_weight FROM edges e LEFT JOIN state s USING (edge_id)",
    "advice0": "SELECT e.edge_id, e.speed_kmh AS limit_kmh, coalesce(s.density, 0) AS density, coalesce(s.density, 0) / greatest(e.length_m / 1000, 0.02::DOUBLE) AS k FROM edges e LEFT JOIN state s USING (edge_id)",
    "advice": """SELECT edge_id, limit_kmh, density, CASE WHEN limit_kmh <= 0 OR density <= 1 THEN limit_kmh WHEN k >= 120 THEN limit_kmh * 0.02::DOUBLE
        ELSE least(limit_kmh, greatest(limit_kmh * 0.02::DOUBLE, limit_kmh * 0.02::DOUBLE + (limit_kmh - limit_kmh * 0.02::DOUBLE) * (1 - k / 120))) END AS recommended_kmh FROM advice0""",
    "ev1": "SELECT * FROM ev WHERE event_id <= (SELECT max(event_id) / 2 FROM ev)",
    "mult1": f"SELECT edge_id, {fold(SAMPLES)} AS weight FROM ev1 WHERE ratio > 0 GROUP BY edge_id",
    "dens1": f"SELECT edge_id, {LEVELS} AS density FROM ev1 WHERE delta IS NOT NULL GROUP BY edge_id",
    "state1": "SELECT edge_id, coalesce(m.weight, 1.0::DOUBLE) AS weight, coalesce(d.density, 0) AS density FROM mult1 m FULL JOIN dens1 d USING (edge_id)",
    "moved": "SELECT edge_id, coalesce(a.weight, 1.0::DOUBLE) AS w1, coalesce(b.weight, 1.0::DOUBLE) AS w2 FROM state1 a FULL JOIN state b USING (edge_id) WHERE abs(coalesce(b.weight, 1.0::DOUBLE) - coalesce(a.weight, 1.0::DOUBLE)) >= 0.1::DOUBLE OR coalesce(a.density, 0) <> coalesce(b.density, 0)",
    "req": """SELECT q.*, s.lat + (request_id % 5 - 2) * 0.00013::DOUBLE AS src_lat, s.lon + (request_id % 5 - 2) * 0.00013::DOUBLE AS src_lon, d.lat + (request_id % 5 - 2) * 0.00013::DOUBLE AS dst_lat, d.lon + (request_id % 5 - 2) * 0.00013::DOUBLE AS dst_lon
      FROM (SELECT s_suppkey AS request_id, (s_suppkey * 13) % n AS src, (s_suppkey * 37 + 11) % n AS dst FROM supplier, n) q JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst""",
    "middle": "SELECT (min(lat) + max(lat)) / 2 AS ref0 FROM nodes",
    "firsts": "SELECT src, dst, min(edge_id) AS edge_id FROM edges GROUP BY src, dst",
    "walk": """SELECT route_id, k AS step_idx, r * 50 + c AS node_idx FROM (
        SELECT request_id AS route_id, k, src // 50 + k // 2 AS r, src % 50 + (k + 1) // 2 AS c FROM req, (SELECT unnest(range(0, 13)) AS k)), n WHERE c < 50 AND r * 50 + c < n""",
    "pairs": "SELECT *, lag(node_idx) OVER (PARTITION BY route_id ORDER BY step_idx) AS prev FROM walk",
    "legs": """SELECT p.route_id, p.step_idx, p.node_idx, p.prev, d.lat, d.lon, f.edge_id, CASE WHEN p.prev IS NULL THEN 0.0::DOUBLE ELSE coalesce(e.length_m, 100.0::DOUBLE) END AS leg_m,
        CASE WHEN p.prev IS NULL THEN 0.0::DOUBLE ELSE coalesce(e.base_weight, 8.0::DOUBLE) END AS leg_sec, e.speed_kmh
      FROM pairs p LEFT JOIN firsts f ON f.src = p.prev AND f.dst = p.node_idx LEFT JOIN edges e ON e.edge_id = f.edge_id JOIN nodes d ON d.id = p.node_idx""",
    "cum": "SELECT *, sum(leg_m) OVER w AS distance_m, sum(leg_sec) OVER w AS time_sec FROM legs WINDOW w AS (PARTITION BY route_id ORDER BY step_idx)",
    "rlegs": "SELECT * FROM (SELECT route_id, step_idx - 1 AS leg_idx, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1, lat AS lat2, lon AS lon2, leg_m, leg_sec, edge_id, lag(distance_m) OVER w AS start_m, max(distance_m) OVER (PARTITION BY route_id) AS total_m FROM cum WINDOW w AS (PARTITION BY route_id ORDER BY step_idx)) WHERE leg_idx >= 0",
    "bent0": "SELECT *, lat + (node_idx % 4) * 0.0003::DOUBLE AS y2, lon + (node_idx % 3) * 0.0004::DOUBLE AS x2 FROM legs",
    "bent1": "SELECT *, lag(y2) OVER w AS y1, lag(x2) OVER w AS x1 FROM bent0 WINDOW w AS (PARTITION BY route_id ORDER BY step_idx)",
    "bent": "SELECT *, step_idx - 1 AS leg_idx, x2 - x1 AS ax, y2 - y1 AS ay FROM bent1 WHERE step_idx > 0",
    "turn0": "SELECT *, lead(ax) OVER w AS bx, lead(ay) OVER w AS cy FROM bent WINDOW w AS (PARTITION BY route_id ORDER BY step_idx)",
    "turns": """SELECT *, CASE WHEN bx IS NOT NULL THEN CASE WHEN sqrt(ax * ax + ay * ay) = 0 OR sqrt(bx * bx + cy * cy) = 0 THEN 0 ELSE degrees(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, (ax * bx + ay * cy) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + cy * cy)))))) END END AS angle,
        CASE WHEN bx IS NULL THEN NULL WHEN (ax = 0 AND ay = 0) OR (bx = 0 AND cy = 0) THEN 0 WHEN ax * cy - ay * bx > 0 THEN 1 ELSE -1 END::BIGINT AS side FROM turn0""",
    "offp": "SELECT *, lat1 + (edge_id % 7 - 3) * 0.0004::DOUBLE AS plat, lon1 + (edge_id % 5 - 2) * 0.0005::DOUBLE AS plon FROM edges",
    "pings": """SELECT event_id, epoch_us(ts) AS us, user_id AS session_id, user_id % s + 1 AS route_id, event_id % 13 AS reported, value / 5 AS speed_kmh, value / 490 * 0.0012::DOUBLE AS off, last_step
      FROM events, (SELECT count(*) AS s FROM supplier) JOIN (SELECT route_id, max(step_idx) AS last_step FROM walk GROUP BY route_id) l ON l.route_id = user_id % s + 1""",
    "adv0": "SELECT *, max(least(reported, last_step)) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS step_idx FROM pings",
    "adv1": "SELECT *, coalesce(lag(step_idx) OVER (PARTITION BY session_id ORDER BY us, event_id), 0) AS prev_step FROM adv0",
    "adv": "SELECT *, step_idx > prev_step AS moved FROM adv1",
    "pos": "SELECT session_id, route_id, max(step_idx) AS step_idx, session_id % 5 <> 0 AS connected FROM adv GROUP BY session_id, route_id",
    "remaining": "SELECT p.session_id, p.route_id, p.step_idx, p.connected, l.step_idx AS s_idx, l.edge_id FROM pos p JOIN legs l USING (route_id) WHERE l.step_idx >= p.step_idx AND l.edge_id IS NOT NULL",
    "pp": "SELECT a.event_id, a.us, a.session_id, a.route_id, a.step_idx, a.speed_kmh, l.lat + a.off AS lat, l.lon - a.off / 3 AS lon FROM adv a JOIN legs l ON l.route_id = a.route_id AND l.step_idx = a.step_idx",
    "segs": f"SELECT route_id, step_idx, {px('lon')} AS bx, {py('lat')} AS cy, lag({px('lon')}) OVER w AS ax, lag({py('lat')}) OVER w AS ay, count(*) OVER (PARTITION BY route_id) AS len FROM legs WINDOW w AS (PARTITION BY route_id ORDER BY step_idx)",
    "dist": f"SELECT p.event_id, p.step_idx AS cursor, s.step_idx, s.len, s.ax, {segment(px('p.lon'), py('p.lat'), 's.ax', 's.ay', 's.bx', 's.cy')} AS d, sqrt(({px('p.lon')} - s.bx) * ({px('p.lon')} - s.bx) + ({py('p.lat')} - s.cy) * ({py('p.lat')} - s.cy)) AS dn FROM pp p JOIN segs s USING (route_id)",
    "near": "SELECT event_id, min(d) FILTER (abs(step_idx - cursor) <= 2 AND ax IS NOT NULL) AS near, min(d) FILTER (ax IS NOT NULL) AS every, min(dn) FILTER (least(greatest(cursor, 0), len - 1) = step_idx) AS node, bool_and(cursor BETWEEN 0 AND len - 1 AND len > 1) AS inside FROM dist GROUP BY event_id",
    "off": "SELECT event_id, CASE WHEN inside THEN CASE WHEN near <= 50 THEN near ELSE coalesce(least(every, near), 0) END ELSE node END AS off_m FROM near",
    "struck0": "SELECT p.*, round(o.off_m, 6) AS off_m, coalesce(round(o.off_m, 6) > 50 AND round(o.off_m, 6) <= 5000, false) AS hit FROM pp p JOIN off o USING (event_id)",
    "struck1": "SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM struck0",
    "struck": "SELECT *, (sum(hit::INT) OVER (PARTITION BY session_id, run ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS strikes FROM struck1",
    "crossings": "SELECT * FROM edges WHERE cell_src <> cell_dst",
    "gate_nodes": "SELECT DISTINCT src AS node_idx, cell_src AS cell FROM crossings UNION SELECT dst, cell_dst FROM crossings",
    "gates": "SELECT row_number() OVER (ORDER BY node_idx) - 1 AS gate_id, node_idx, cell FROM gate_nodes",
    "inner_edges": "SELECT src, dst, cell_src AS cell, min(wt) AS wt FROM edges WHERE cell_src = cell_dst GROUP BY ALL",
    "sc(root, node, cost) USING KEY (root, node)": """SELECT node_idx, node_idx, 0::BIGINT FROM gates
      UNION SELECT s.root, e.dst, min(s.cost + e.wt) FROM sc s JOIN inner_edges e ON e.src = s.node LEFT JOIN recurring.sc r ON r.root = s.root AND r.node = e.dst WHERE r.cost IS NULL OR s.cost + e.wt < r.cost GROUP BY s.root, e.dst""",
    "shortcuts": "SELECT g.cell, root AS src, node AS dst, cost AS weight FROM sc JOIN gates g ON g.node_idx = root JOIN gates h ON h.node_idx = node WHERE root <> node",
    "over0": "SELECT src, dst, wt AS weight, true AS is_cross_cell, edge_id AS store_idx FROM crossings UNION ALL SELECT src, dst, weight, false, row_number() OVER (ORDER BY src, dst) - 1 FROM shortcuts",
    "overlay": "SELECT *, row_number() OVER (ORDER BY src, is_cross_cell, dst, store_idx) - 1 AS overlay_id FROM over0",
    "hops": "SELECT src, dst, min(wt) AS wt FROM edges GROUP BY src, dst",
    "sp(root, node, cost) USING KEY (root, node)": """SELECT DISTINCT src, src, 0::BIGINT FROM req
      UNION SELECT s.root, e.dst, min(s.cost + e.wt) FROM sp s JOIN hops e ON e.src = s.node LEFT JOIN recurring.sp r ON r.root = s.root AND r.node = e.dst WHERE r.cost IS NULL OR s.cost + e.wt < r.cost GROUP BY s.root, e.dst""",
    "best": "SELECT request_id, src, dst, cost FROM req JOIN sp ON root = src AND node = dst WHERE src <> dst",
    "ceilings": "SELECT *, CASE WHEN leg_m > 0 AND leg_sec > 0 THEN leg_m / leg_sec * 3.6::DOUBLE ELSE 50.0::DOUBLE END AS own FROM rlegs",
    "slegs": "SELECT l.*, CASE WHEN a.recommended_kmh > 0 THEN a.recommended_kmh WHEN a.limit_kmh > 0 THEN a.limit_kmh ELSE own END AS base_kmh FROM ceilings l LEFT JOIN advice a USING (edge_id)",
    "cars": "SELECT s_suppkey AS car_id, s_suppkey AS route_id, s_suppkey % 3 AS start_step, 0.85::DOUBLE + 0.30::DOUBLE * (s_suppkey % 10) / 10.0::DOUBLE AS pace FROM supplier",
    "carlegs": "SELECT c.*, l.leg_idx, l.base_kmh, least(greatest(base_kmh * pace, 8.0::DOUBLE), base_kmh * 1.1::DOUBLE) AS kmh, CASE WHEN leg_m > 0 THEN leg_m ELSE 0.1::DOUBLE END AS len, lat1, lon1, lat2, lon2 FROM cars c JOIN slegs l USING (route_id)",
    "timed0": "SELECT *, sum(len / (kmh / 3.6::DOUBLE)) OVER (PARTITION BY car_id ORDER BY leg_idx) AS fin FROM carlegs WHERE leg_idx >= start_step",
    "timed": "SELECT *, coalesce(lag(fin) OVER (PARTITION BY car_id ORDER BY leg_idx), 0.0::DOUBLE) AS beg FROM timed0",
    "ridden": "SELECT car_id, min(leg_idx) FILTER (fin > 45) AS leg_idx, arg_min((45.0::DOUBLE - beg) * (kmh / 3.6::DOUBLE), leg_idx) FILTER (fin > 45) AS progress_m, count(*) FILTER (fin <= 45) AS legs_done FROM timed GROUP BY car_id",
}


def sql(body: str, **extra: str) -> str:
    """``body`` after the views that it may use, in order; ``extra`` are further ones, used by it."""
    words = set(re.findall(r"[a-z_0-9]+", " ".join([body, *extra.values()])))
    own: list[str] = []
    for key in reversed(VIEWS):  # each uses earlier ones only
        if key.split("(")[0] in words:
            own.append(key)
            words |= set(re.findall(r"[a-z_0-9]+", VIEWS[key]))
    views = {**{k: VIEWS[k] for k in reversed(own)}, **{HEADS.get(k, k): v for k, v in extra.items()}}
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS {'' if '(' in k else 'MATERIALIZED '}({v})" for k, v in views.items()) + "\n" + body


#: Columns of further recursive views.
HEADS = {
    **{k: f"{k}(job, node, hops, cost)" for k in ("rep", "rov")}, **{k: f"{k}(root, node, cost) USING KEY (root, node)" for k in ("cd", "ov", "cu", "lsp", "fsp", *(f"a{i}" for i in range(5)))},
    **{f"pb{i}": f"pb{i}(key, root, node, back)" for i in range(5)},
}
LONG_WAY = "SELECT r * 10 + c // 5 AS way_id, list(id ORDER BY id) || CASE WHEN r % 11 = 0 AND c // 5 = 0 THEN [-1::BIGINT] ELSE []::BIGINT[] END AS refs FROM nodes GROUP BY r, c // 5"


def relax(table: str, edges: str, name: str) -> str:
    return f"UNION SELECT s.root, e.dst, min(s.cost + e.wt) FROM {name} s JOIN {edges} e ON e.src = s.node LEFT JOIN recurring.{name} r ON r.root = s.root AND r.node = e.dst WHERE r.cost IS NULL OR s.cost + e.wt < r.cost GROUP BY s.root, e.dst"


def tight(labels: str, edges: str, weight: str = "e.wt", join: str = "") -> str:
    """Per (root, node) the edge by which its cheapest path comes in; of several that from the smaller node, then the smaller edge."""
    return f"SELECT a.root, e.dst AS node, min({{'src': e.src, 'edge_id': e.edge_id}}) AS p FROM {labels} a JOIN {edges} e ON e.src = a.node {join} JOIN {labels} b ON b.root = a.root AND b.node = e.dst WHERE a.cost + {weight} = b.cost GROUP BY a.root, e.dst"


def path_views(k: int, jobs: str, ends: str) -> dict[str, str]:
    """Views ``pb`` and ``steps``: the paths of ``jobs`` (key, root, dst) walked back over ``ends`` (as from ``tight``)."""
    return {
        f"pb{k}": f"SELECT key, root, dst, 0 FROM ({jobs}) UNION ALL SELECT b.key, b.root, t.p.src, b.back + 1 FROM pb{k} b JOIN {ends} t ON t.root = b.root AND t.node = b.node",
        f"steps{k}": f"SELECT b.key, (max(back) OVER (PARTITION BY b.key) - back)::BIGINT AS step_idx, b.node AS node_idx, t.p.edge_id AS edge_id FROM pb{k} b LEFT JOIN {ends} t ON t.root = b.root AND t.node = b.node",
    }


def alternatives(n: int) -> dict[str, str]:
    """Labels, paths and used edges of ``n`` searches per request, each with the edges of the earlier ones at five times their weight."""
    out: dict[str, str] = {}
    for k in range(n):
        dear = f"LEFT JOIN used{k} u ON u.key = {{}}.root AND u.edge_id = e.edge_id" if k else ""
        w = "e.wt * CASE WHEN u.key IS NULL THEN 1 ELSE 5 END" if k else "e.wt"
        if k:
            out[f"used{k}"] = " UNION ".join(f"SELECT key, edge_id FROM steps{j} WHERE edge_id IS NOT NULL" for j in range(k))
        out[f"a{k}"] = f"SELECT request_id, src, 0::BIGINT FROM best UNION SELECT s.root, e.dst, min(s.cost + {w}) FROM a{k} s JOIN edges e ON e.src = s.node {dear.format('s')} LEFT JOIN recurring.a{k} r ON r.root = s.root AND r.node = e.dst WHERE r.cost IS NULL OR s.cost + {w} < r.cost GROUP BY s.root, e.dst"
        out[f"t{k}"] = tight(f"a{k}", "edges", w, dear.format("a"))
        out |= path_views(k, "SELECT request_id AS key, request_id AS root, dst FROM best", f"t{k}")
    return out


LIVE_EDGES = "SELECT edge_id, src, dst, cell_src, cell_dst, round(round(live_weight, 6) * 100)::BIGINT AS wt FROM live"
LIVE_HOPS = "SELECT src, dst, min(wt) AS wt FROM ledges GROUP BY src, dst"
#: From the node of each route's cursor to its end.
JOBS = "SELECT c.route_id AS job, c.step_idx AS cursor, c.node_idx AS src, d.dst FROM legs c JOIN (SELECT route_id, arg_max(node_idx, step_idx) AS dst FROM legs GROUP BY route_id) d USING (route_id) WHERE c.step_idx = c.route_id % 7"


def later() -> dict[str, str]:
    """The session lifecycle, whole paths, the clients and the streams in several batches."""
    k = "s_suppkey"
    live_from = lambda roots: {"ledges": LIVE_EDGES, "lhop": LIVE_HOPS, "lsp": f"SELECT DISTINCT src, src, 0::BIGINT FROM {roots} {relax('', 'lhop', 'lsp')}"}
    born = f"SELECT session_id, session_id AS route_id, greatest(0, least(session_id % 17 - 2, last)) AS step_idx FROM (SELECT {k} AS session_id, max(l.step_idx) AS last FROM supplier JOIN legs l ON l.route_id = {k} GROUP BY {k})"
    born_edge = "SELECT b.session_id, b.step_idx, max(l.edge_id) FILTER (l.step_idx = CASE WHEN b.step_idx = 0 THEN 1 ELSE b.step_idx END) AS edge_id, count(*) FILTER (l.step_idx >= b.step_idx AND l.edge_id IS NOT NULL) AS subscribed FROM born b JOIN legs l USING (route_id) GROUP BY b.session_id, b.step_idx"
    walked = live_from("jobs") | {"lt": tight("lsp", "ledges")} | path_views(0, "SELECT job AS key, src AS root, dst FROM jobs WHERE job % 2 = 0 AND src <> dst", "lt")
    updates = {"jobs": JOBS, **walked, "wish": "SELECT job, cursor, cost / 100.0::DOUBLE AS eta FROM jobs JOIN lsp ON root = src AND node = dst WHERE job % 2 = 0 AND src <> dst", "taken": "SELECT * FROM wish WHERE job % 4 <> 0"}
    ticks = "list_reduce(list_prepend({'held': 0::BIGINT, 'p': 0::BIGINT, 'n': 0::BIGINT, 'o': 0::BIGINT}, list({'held': 0::BIGINT, 'p': event_id * 37 % 1700, 'n': 0::BIGINT, 'o': 0::BIGINT} ORDER BY event_id)), lambda a, x: {'held': least(250, a.held + x.p - 250 * least(4, (a.held + x.p) // 250)), 'p': 0::BIGINT, 'n': a.n + least(4, (a.held + x.p) // 250), 'o': a.o + CASE WHEN a.held + x.p - 250 * least(4, (a.held + x.p) // 250) >= 250 THEN 1 ELSE 0 END})"
    client = {
        "crow": f"SELECT {k} AS car_id, {k} % 4 AS leg0, {k} % 9 * 5.0::DOUBLE AS done_m, {k} % 6 * 700.0::DOUBLE + 2500 AS edge_ms, {k} % 13 * 35.0::DOUBLE AS mv, l.*, CASE WHEN l.leg_m > 0 THEN l.leg_m ELSE 0.1::DOUBLE END AS len FROM supplier JOIN rlegs l ON l.route_id = {k} WHERE l.leg_idx >= {k} % 4",
        "cfar": "SELECT *, sum(len) OVER (PARTITION BY car_id ORDER BY leg_idx) - done_m AS fin FROM crow",
        "cnow": "SELECT *, coalesce(lag(fin) OVER w, 0.0::DOUBLE) AS beg, lag(2500.0::DOUBLE * (mv - fin) / nullif(mv, 0)) OVER w AS spilt, 2500.0::DOUBLE * (mv - fin) / nullif(mv, 0) AS spill FROM cfar WINDOW w AS (PARTITION BY car_id ORDER BY leg_idx)",
        "cend": "SELECT *, fin <= mv AND beg < mv AS done FROM cnow",
        "cat": "SELECT car_id, count(*) FILTER (done) AS legs_done, min(leg_idx) FILTER (NOT done) AS leg_idx, max(leg_idx) AS last FROM cend GROUP BY car_id",
    }
    batch = "event_id * 4 // ((SELECT max(event_id) FROM {}) + 1)"
    bev = f"SELECT *, {batch.format('ev')} AS b FROM ev"
    upto = "SELECT q.b, e.edge_id, coalesce(" + fold(SAMPLES + " FILTER (ratio > 0)") + ", 1.0::DOUBLE) AS w, coalesce(list_reduce(list_prepend(0::BIGINT, list(delta ORDER BY us, event_id) FILTER (delta IS NOT NULL)), lambda a, x: greatest(0::BIGINT, a + x)), 0::BIGINT) AS d FROM (SELECT DISTINCT b, edge_id FROM bev) q JOIN bev e ON e.edge_id = q.edge_id AND e.b <= q.b GROUP BY q.b, e.edge_id"
    said = "list_reduce(list_prepend({'b': -1::BIGINT, 'w': 1.0::DOUBLE, 'd': 0::BIGINT, 'sw': 1.0::DOUBLE, 'sd': 0::BIGINT, 'o': []::STRUCT(b BIGINT, x DOUBLE, y DOUBLE)[]}, list({'b': b, 'w': w, 'd': d, 'sw': 0.0::DOUBLE, 'sd': 0::BIGINT, 'o': []::STRUCT(b BIGINT, x DOUBLE, y DOUBLE)[]} ORDER BY b)), lambda a, x: CASE WHEN abs(x.w - a.sw) >= 0.1::DOUBLE OR x.d <> a.sd THEN {'b': x.b, 'w': x.w, 'd': x.d, 'sw': x.w, 'sd': x.d, 'o': list_append(a.o, {'b': x.b, 'x': a.sw, 'y': x.w})} ELSE {'b': x.b, 'w': x.w, 'd': x.d, 'sw': a.sw, 'sd': a.sd, 'o': a.o} END).o"
    snapped = lambda rows, key, lat, lon: f"SELECT {key}, arg_min(nodes.id, {{'d2': ({px(lon)} - {px('nodes.lon')}) * ({px(lon)} - {px('nodes.lon')}) + ({py(lat)} - {py('nodes.lat')}) * ({py(lat)} - {py('nodes.lat')}), 'id': nodes.id}}) AS node FROM {rows}, nodes GROUP BY {key}"
    live_cells = {
        "linner": "SELECT src, dst, min(wt) AS wt FROM ledges WHERE cell_src = cell_dst GROUP BY src, dst",
        "cu": f"SELECT node_idx, node_idx, 0::BIGINT FROM gates {relax('', 'linner', 'cu')}",
        "lover": "SELECT src, dst, min(wt) AS wt FROM (SELECT src, dst, wt FROM ledges WHERE cell_src <> cell_dst UNION ALL SELECT root, node, cost FROM cu JOIN gates g ON g.node_idx = node WHERE root <> node) GROUP BY src, dst",
    }
    around = lambda name, kind, hops, over: f"SELECT job, src, 0, 0::BIGINT FROM trig WHERE {kind} UNION ALL SELECT r.job, e.dst, r.hops + 1, min(r.cost + e.wt) FROM {name} r JOIN trig c USING (job) JOIN {over} e ON e.src = r.node WHERE r.node <> c.dst AND r.hops < {hops} AND r.cost + e.wt <= c.wt AND NOT (e.src = c.src AND e.dst = c.dst) GROUP BY r.job, e.dst, r.hops + 1"
    dear = "CASE WHEN s.root % 3 = 0 AND e.overlay_id % 10 = 0 AND e.overlay_id % 50 = s.root % 5 * 10 THEN 5 ELSE 1 END"
    shift = "CASE WHEN event_id % 3 = 0 THEN 90.0::DOUBLE ELSE 0.0::DOUBLE END"
    turned = {
        "sp0": f"SELECT event_id, route_id, step_idx, lat AS la, lon + {shift} AS lo, {shift} AS by FROM pp",
        "sp1": "SELECT s.event_id, s.step_idx AS cursor, g.step_idx, g.len, g.ax IS NOT NULL AS inner_seg, s.la, s.lo, l.lat AS lat2, l.lon + s.by AS lon2, lag(l.lat) OVER w AS lat1, lag(l.lon + s.by) OVER w AS lon1 FROM sp0 s JOIN legs l USING (route_id) JOIN segs g ON g.route_id = l.route_id AND g.step_idx = l.step_idx WINDOW w AS (PARTITION BY s.event_id ORDER BY l.step_idx)",
    }
    for name, la, lo in (("u", "CASE WHEN event_id % 3 = 0 THEN lo ELSE la END", "CASE WHEN event_id % 3 = 0 THEN la ELSE lo END"), ("v", "la", "lo")):
        turned[f"{name}d"] = f"SELECT *, {segment(px(f'({lo})'), py(f'({la})'), px('lon1'), py('lat1'), px('lon2'), py('lat2'))} AS d, sqrt(({px(f'({lo})')} - {px('lon2')}) * ({px(f'({lo})')} - {px('lon2')}) + ({py(f'({la})')} - {py('lat2')}) * ({py(f'({la})')} - {py('lat2')})) AS dn FROM sp1"
        turned[f"{name}n"] = f"SELECT event_id, min(d) FILTER (abs(step_idx - cursor) <= 2 AND inner_seg) AS near, min(d) FILTER (inner_seg) AS every, min(dn) FILTER (least(greatest(cursor, 0), len - 1) = step_idx) AS node, bool_and(cursor BETWEEN 0 AND len - 1 AND len > 1) AS inside FROM {name}d GROUP BY event_id"
        turned[f"{name}o"] = f"SELECT event_id, CASE WHEN inside THEN CASE WHEN near <= 50 THEN near ELSE coalesce(least(every, near), 0) END ELSE node END AS off_m FROM {name}n"
    flagship = {
        "fends": "SELECT s.request_id, s.node AS src, d.node AS dst FROM fsrc s JOIN fdst d USING (request_id)",
        "fsp": f"SELECT DISTINCT src, src, 0::BIGINT FROM fends {relax('', 'hops', 'fsp')}",
        "ft": tight("fsp", "edges"),
    }
    found = "SELECT request_id AS key, src AS root, dst FROM fends JOIN fsp ON root = src AND node = dst WHERE src <> dst"
    return {
        "r04_same_cell": sql("SELECT request_id, src, dst, cost FROM near2 JOIN cd ON root = src AND node = dst", near2="SELECT request_id, src, src + 2 AS dst FROM req JOIN nodes a ON a.id = src JOIN nodes b ON b.id = src + 2 WHERE a.cell = b.cell", cd=f"SELECT DISTINCT src, src, 0::BIGINT FROM req {relax('', 'inner_edges', 'cd')}"),
        "r06_many_gates": sql(
            "SELECT request_id, g.node_idx, ov.cost FROM req JOIN nodes d ON d.id = dst JOIN gates g ON g.cell = d.cell JOIN ov ON ov.root = request_id AND ov.node = g.node_idx",
            cd=f"SELECT DISTINCT src, src, 0::BIGINT FROM req {relax('', 'inner_edges', 'cd')}",
            ov=f"SELECT request_id, node, cost FROM req JOIN cd ON root = src JOIN gates ON node_idx = node UNION SELECT s.root, e.dst, min(s.cost + e.weight * {dear}) FROM ov s JOIN overlay e ON e.src = s.node LEFT JOIN recurring.ov r ON r.root = s.root AND r.node = e.dst WHERE r.cost IS NULL OR s.cost + e.weight * {dear} < r.cost GROUP BY s.root, e.dst",
        ),
        "r08_paths": sql("SELECT key AS request_id, step_idx, node_idx, edge_id FROM steps0", t0=tight("sp", "edges"), **path_views(0, "SELECT request_id AS key, src AS root, dst FROM best", "t0")),
        "r11_routes": sql(" UNION ALL ".join(f"SELECT key AS request_id, {j}::BIGINT AS alternative, step_idx, node_idx, edge_id FROM steps{j}" for j in range(5)), **alternatives(5)),
        "flagship_routes": sql(
            "SELECT s.key AS request_id, s.step_idx, s.node_idx, s.edge_id, round(sum(coalesce(length_m, 0.0::DOUBLE)) OVER w, 3) AS distance_m, round(sum(coalesce(base_weight, 0.0::DOUBLE)) OVER w, 3) AS time_sec, round(sum(coalesce(live_weight, 0.0::DOUBLE)) OVER w, 3) AS live_sec, count(*) FILTER (live_weight >= 1.5::DOUBLE * base_weight) OVER (PARTITION BY s.key) AS congested_edges FROM steps0 s LEFT JOIN live USING (edge_id) WINDOW w AS (PARTITION BY s.key ORDER BY s.step_idx)",
            fsrc=snapped("req", "request_id", "src_lat", "src_lon"), fdst=snapped("req", "request_id", "dst_lat", "dst_lon"), **flagship, **path_views(0, found, "ft"),
        ),
        "o11_swapped": sql("SELECT event_id AS point_id, round(CASE WHEN event_id % 3 = 0 AND lo > 90 THEN least(u.off_m, v.off_m) ELSE u.off_m END, 3) AS off_m FROM uo u JOIN vo v USING (event_id) JOIN sp0 USING (event_id)", **turned),
        "t16_refill": sql("SELECT DISTINCT edge_id FROM ev WHERE event_id > (SELECT max(event_id) / 2 FROM ev) AND ratio > 0 UNION SELECT edge_id FROM state WHERE abs(weight - 1) >= 0.05::DOUBLE"),
        "n01_create": sql("SELECT session_id, step_idx, 1::BIGINT AS revision, session_id * 1000 AS last_ping_us, session_id * 1000 AS last_reroute_us, edge_id, subscribed FROM born_edge", born=born, born_edge=born_edge),
        "n02_delete": sql("SELECT DISTINCT session_id, edge_id FROM remaining WHERE session_id % 4 = 0"),
        "n03_presence": sql("SELECT edge_id, sum(CASE WHEN session_id % 3 = 0 THEN 0 ELSE 1 END)::BIGINT AS delta FROM born_edge WHERE edge_id IS NOT NULL GROUP BY edge_id", born=born, born_edge=born_edge),
        "n12_candidates": sql(
            "SELECT t.job AS route_id, CASE WHEN p.cost IS NOT NULL THEN 'local_patch' ELSE 'full_route' END AS kind, coalesce(p.cost, f.cost) AS cost FROM trig t LEFT JOIN patched p USING (job) LEFT JOIN whole f USING (job) WHERE coalesce(p.cost, f.cost) IS NOT NULL",
            jobs=JOBS, **live_from("jobs"), **live_cells,
            trig="SELECT f.route_id AS job, e.src, e.dst, e.wt, e.cell_src <> e.cell_dst AS x FROM (SELECT l.route_id, arg_min(l.edge_id, l.step_idx) AS edge_id FROM legs l JOIN live v USING (edge_id) WHERE l.step_idx >= l.route_id % 7 AND v.live_weight >= 2 * v.base_weight AND v.live_weight - v.base_weight >= 20 GROUP BY l.route_id) f JOIN ledges e USING (edge_id)",
            rep=around("rep", "NOT x", 20, "lhop"), rov=around("rov", "x", 5, "lover"),
            patched="SELECT job, min(cost) AS cost FROM (SELECT * FROM rep UNION ALL SELECT * FROM rov) JOIN trig USING (job) WHERE node = trig.dst AND hops > 0 GROUP BY job",
            whole="SELECT job, cost FROM jobs JOIN lsp ON root = src AND node = dst WHERE src <> dst",
        ),
        "n15_apply": sql("SELECT j.job AS session_id, CASE WHEN t.job IS NULL THEN j.job ELSE -j.job END AS route_id, CASE WHEN t.job IS NULL THEN j.cursor ELSE 1 END AS step_idx, CASE WHEN t.job IS NULL THEN 1 ELSE 2 END::BIGINT AS revision, CASE WHEN t.job IS NULL THEN 0 ELSE 7000000 END::BIGINT AS last_reroute_us, t.job IS NOT NULL AS rerouted, round(t.eta, 3) AS eta_sec FROM jobs j LEFT JOIN taken t USING (job)", **updates),
        "n15_subscriptions": sql(
            "SELECT session_id, edge_id, CASE WHEN n.k IS NULL THEN 'unsubscribe' ELSE 'subscribe' END AS change FROM olds o FULL JOIN news n USING (session_id, edge_id) WHERE o.k IS NULL OR n.k IS NULL", **updates,
            olds="SELECT DISTINCT job AS session_id, edge_id, 1 AS k FROM jobs JOIN legs ON route_id = job AND step_idx >= cursor WHERE edge_id IS NOT NULL",
            news="SELECT * FROM olds WHERE session_id NOT IN (SELECT job FROM taken) UNION ALL SELECT DISTINCT key, edge_id, 1 FROM steps0 JOIN taken ON job = key WHERE edge_id IS NOT NULL AND step_idx >= 1",
        ),
        "n17_off_route_reroute": sql(
            "SELECT request_id AS session_id, src, dst, cost FROM ojobs JOIN lsp ON root = src AND node = dst WHERE src <> dst",
            olast="SELECT session_id, arg_max({'route_id': route_id, 'lat': lat, 'lon': lon}, (us, event_id)) AS p FROM struck WHERE hit AND strikes >= 2 GROUP BY session_id", oflat="SELECT session_id, p.route_id AS route_id, p.lat AS plat, p.lon AS plon FROM olast",
            onode=snapped("oflat", "session_id", "plat", "plon"), ojobs="SELECT session_id AS request_id, node AS src, dst FROM onode JOIN oflat USING (session_id) JOIN (SELECT route_id, arg_max(node_idx, step_idx) AS dst FROM legs GROUP BY route_id) USING (route_id)", **live_from("ojobs"),
        ),
        "v01_ticks": f"SELECT key, t.n AS steps, t.o AS overloads FROM (SELECT user_id AS key, {ticks} AS t FROM events GROUP BY user_id)",
        "v04_samples": sql("SELECT car_id, leg_idx, edge_id, round(kmh, 6) AS kmh, CASE WHEN kmh > 0 AND edge_id IS NOT NULL AND q >= 1 THEN floor(q - 1)::BIGINT + 1 ELSE 0 END AS samples FROM (SELECT c.*, l.edge_id, floor(round(len / (kmh / 3.6::DOUBLE), 6) / 0.25::DOUBLE + 1e-9::DOUBLE) * 0.25::DOUBLE AS q FROM carlegs c JOIN rlegs l ON l.route_id = c.route_id AND l.leg_idx = c.leg_idx WHERE c.leg_idx >= c.start_step)"),
        "v07_adopt": f"WITH s AS (SELECT {k} AS session_id, {k} % 4 AS rev, {k} % 5 AS step, 32 + {k} * 0.001::DOUBLE AS lat, 34 + {k} * 0.002::DOUBLE AS lon FROM supplier), j AS (SELECT *, coalesce(rev <> 0 AND rev <> {k} % 3, false) AS adopted FROM supplier LEFT JOIN s ON session_id = {k} - 1) SELECT {k} AS car_id, CASE WHEN adopted THEN rev ELSE {k} % 3 END AS revision, CASE WHEN adopted THEN step ELSE {k} % 9 END AS step_idx, CASE WHEN adopted THEN 0.0::DOUBLE ELSE {k} * 1.5::DOUBLE END AS progress_m, round(lat, 6) AS lat, round(lon, 6) AS lon, adopted FROM j",
        "v13_client_advance": sql(
            "SELECT car_id, legs_done, leg_idx, round(m, 3) AS progress_m, round(coalesce(lat1 + (lat2 - lat1) * m / len, elat), 6) AS lat, round(coalesce(lon1 + (lon2 - lon1) * m / len, elon), 6) AS lon FROM (SELECT c.car_id, c.legs_done, c.leg_idx, CASE WHEN n.leg_idx = n.leg0 THEN n.done_m ELSE 0 END + greatest(0.0::DOUBLE, n.mv - greatest(0.0::DOUBLE, n.beg)) AS m, n.len, n.lat1, n.lat2, n.lon1, n.lon2, e.lat2 AS elat, e.lon2 AS elon FROM cat c LEFT JOIN cend n ON n.car_id = c.car_id AND n.leg_idx = c.leg_idx JOIN cend e ON e.car_id = c.car_id AND e.leg_idx = c.last)", **client,
        ),
        "v13_edge_events": sql("SELECT car_id, leg_idx, edge_id, round(o, 6) AS observed_sec FROM (SELECT *, greatest(0.0::DOUBLE, CASE WHEN leg_idx = leg0 THEN edge_ms ELSE spilt END - spill) / 1000 AS o FROM cend WHERE done AND edge_id IS NOT NULL) WHERE o > 0", **client),
        "s13_outbox": sql("SELECT session_id, least(count(*), 4) AS sent, greatest(count(*) - 4, 0) AS lost FROM pings GROUP BY session_id"),
        "s14_latest": sql("SELECT session_id, max(event_id) AS event_id, arg_max(route_id, event_id) AS route_id, arg_max(reported, event_id) AS reported FROM pings GROUP BY session_id"),
        "p18_mode_error": f"""SELECT {k}, CASE WHEN {k} % 5 = 4 THEN 'unknown routing mode "fastest"' END AS error FROM supplier""",
        "p19_default_viewbox": sql(f"SELECT {k}, CASE WHEN {k} % 3 = 0 THEN '1,2,3,4' ELSE v END AS viewbox FROM supplier, (SELECT printf('%.6f,%.6f,%.6f,%.6f', min(lon), max(lat), max(lon), min(lat)) AS v FROM nodes)"),
        "j12_nearby_or_all": sql("SELECT request_id AS point_id, count(*) AS cars, min(edge_id) AS first_car FROM req, offp WHERE request_id % 10 = 0 OR (abs(floor(src_lat * 111320.0::DOUBLE / 120) - floor(plat * 111320.0::DOUBLE / 120)) <= 1 AND abs(floor(src_lon * (111320.0::DOUBLE * cos(radians(32.02::DOUBLE))) / 120) - floor(plon * (111320.0::DOUBLE * cos(radians(32.02::DOUBLE))) / 120)) <= 1) GROUP BY request_id"),
        "stream_t09": sql("SELECT o.b AS batch, edge_id, round(o.x, 6) AS old_multiplier, round(o.y, 6) AS new_multiplier FROM (SELECT edge_id, unnest(said) AS o FROM told)", bev=bev, upto=upto, told=f"SELECT edge_id, {said} AS said FROM upto GROUP BY edge_id"),
        "stream_t10": sql(f"SELECT edge_id, count(DISTINCT {batch.format('(SELECT event_id FROM ev WHERE ratio > 0)')}) AS handed_over FROM ev WHERE ratio > 0 GROUP BY edge_id"),
        "stream_s12": "SELECT event_id AS step_index, user_id + 0.5::DOUBLE AS speed_kmh FROM events WHERE event_type <> 'error' AND event_id % 17 <> 0",
    }


def oracles() -> dict[str, str]:
    k, half = "s_suppkey", "floor({} + 0.5)"
    snap_lat, snap_lon = "(src_lat + 0.00011::DOUBLE)", "(src_lon + request_id % 3 * 0.0007::DOUBLE + 0.00007::DOUBLE)"
    ref = "ref0"
    sx = lambda lon: f"(radians({lon}) * cos(radians({ref})) * {R})"
    eta60 = f"round({haversine('src_lat', 'src_lon', 'dst_lat', 'dst_lon')} / (30 / 3.6::DOUBLE), 3)"
    bearing = "degrees(atan2(x2 - x1, y2 - y1))"
    unit = lambda text: f"(('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"
    near = lambda axis, j: f"(greatest(min_{axis}, src_{axis} - 0.25::DOUBLE) + (least(max_{axis}, src_{axis} + 0.25::DOUBLE) - greatest(min_{axis}, src_{axis} - 0.25::DOUBLE)) * {unit(f'car_id || $$/{j}/$$ || attempt')})"
    profile = lambda f, lo, hi: f"round({lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * (abs(sin({k} / 100.0::DOUBLE * {f}::DOUBLE)) % 1), 6)"
    decay = "list_reduce(list_prepend(a.w, list_transform(range(0, least(64, floor((x.us - a.us) / 2000000)::BIGINT)), lambda i: -1.0::DOUBLE)), lambda w, i: CASE WHEN abs((1 + (w - 1) * 0.5::DOUBLE) - 1) < 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 1 + (w - 1) * 0.5::DOUBLE END)"
    decayed = f"list_reduce(list_prepend({{'us': NULL::BIGINT, 'w': 1.0::DOUBLE, 'ratio': 0.0::DOUBLE, 'alpha': 0.0::DOUBLE}}, list({{'us': us, 'w': 1.0::DOUBLE, 'ratio': ratio, 'alpha': alpha}} ORDER BY us, event_id)), lambda a, x: {{'us': x.us, 'w': greatest(1.0::DOUBLE, x.alpha * greatest(1.0::DOUBLE, x.ratio) + (1 - x.alpha) * CASE WHEN a.us IS NULL THEN 1.0::DOUBLE ELSE {decay} END), 'ratio': x.ratio, 'alpha': x.alpha}}).w"
    throttle = "list_reduce(list_prepend({'last': NULL::BIGINT, 'us': 0::BIGINT, 'id': 0::BIGINT, 'ids': []::BIGINT[]}, list({'last': NULL::BIGINT, 'us': us, 'id': event_id, 'ids': []::BIGINT[]} ORDER BY us, event_id)), lambda a, x: CASE WHEN a.last IS NULL OR x.us - a.last >= 3600000000 THEN {'last': x.us, 'us': x.us, 'id': x.id, 'ids': list_append(a.ids, x.id)} ELSE a END).ids"
    decide = "list_reduce(list_prepend({'last': min(us), 'us': 0::BIGINT, 'id': 0::BIGINT, 'o': false, 'c': false, 'ids': []::BIGINT[], 'why': []::VARCHAR[]}, list({'last': NULL::BIGINT, 'us': us, 'id': event_id, 'o': hit AND strikes >= 2, 'c': event_id % 4 = 0, 'ids': []::BIGINT[], 'why': []::VARCHAR[]} ORDER BY us, event_id)), lambda a, x: CASE WHEN x.us - a.last >= 10000000 AND (x.o OR x.c) THEN {'last': x.us, 'us': x.us, 'id': x.id, 'o': x.o, 'c': x.c, 'ids': list_append(a.ids, x.id), 'why': list_append(a.why, CASE WHEN x.o THEN 'off_route' ELSE 'congestion' END)} ELSE a END)"
    speed_up = "list_reduce(list_prepend({'v': 0.0::DOUBLE, 'b': 0.0::DOUBLE}, list({'v': 0.0::DOUBLE, 'b': base_kmh} ORDER BY leg_idx)), lambda a, x: {'v': greatest(0.0::DOUBLE, (a.v / 3.6::DOUBLE + greatest(-(CASE WHEN (least(greatest(x.b * 1.1::DOUBLE, 0.5::DOUBLE), greatest(8.0::DOUBLE, x.b * 1.05::DOUBLE)) - a.v) / 3.6::DOUBLE >= 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END), least((CASE WHEN (least(greatest(x.b * 1.1::DOUBLE, 0.5::DOUBLE), greatest(8.0::DOUBLE, x.b * 1.05::DOUBLE)) - a.v) / 3.6::DOUBLE >= 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END), (least(greatest(x.b * 1.1::DOUBLE, 0.5::DOUBLE), greatest(8.0::DOUBLE, x.b * 1.05::DOUBLE)) - a.v) / 3.6::DOUBLE))) * 3.6::DOUBLE), 'b': x.b}).v"
    ids_text = "coalesce(string_agg(edge_id::VARCHAR, ',' ORDER BY step_idx), '')"
    tail = "FROM (SELECT route_id, coalesce(list(edge_id ORDER BY step_idx) FILTER (edge_id IS NOT NULL), []::BIGINT[]) AS a FROM legs GROUP BY route_id)"
    out = {
        "s01_referenced_nodes": sql(f"SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM nodes WHERE id IN (SELECT unnest(refs) FROM ({LONG_WAY}))"),
        "s07_region_tree": "WITH f AS (SELECT 'r' || r_regionkey AS id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation WHERE n_nationkey % 9 <> 8) SELECT id, name, parent, coalesce((SELECT string_agg(c.id, ',' ORDER BY c.id) FROM f c WHERE c.parent = f.id), '') AS children FROM f",
        "s08_ready_regions": f"WITH f AS (SELECT 'maps/n' || s_nationkey || CASE WHEN {k} % 4 = 0 THEN '/sub' ELSE '' END AS dir, {k} % 3 AS p FROM supplier), ready AS (SELECT dir FROM f GROUP BY dir HAVING count(DISTINCT p) = 3) SELECT dir FROM ready WHERE NOT EXISTS (SELECT 1 FROM ready o WHERE starts_with(ready.dir, o.dir || '/'))",
        "s11_parse_latlon": f"SELECT {k}, CASE WHEN ok THEN la END AS lat, CASE WHEN ok THEN lo END AS lon, CASE WHEN ok THEN printf('%.5f, %.5f', la, lo) END AS label FROM (SELECT {k}, ({k} % 120)::DOUBLE AS la, -({k} % 200) - 0.25::DOUBLE AS lo, {k} % 7 <> 0 AND {k} % 120 <= 90 AND {k} % 200 + 0.25 <= 180 AS ok FROM supplier)",
        "s12_parse_pings": "SELECT event_id, floor(value)::DOUBLE AS speed_kmh, event_id % 9 AS step_index, user_id AS edge_id, event_id % 60 + 0.5::DOUBLE AS observed_sec FROM events WHERE event_type <> 'error' AND event_id % 17 <> 0",
        "s15_route_cache": "SELECT user_id AS route_id, max(ts) AS created_at FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier) GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTE",
        "s16_system_info": sql("SELECT round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, round((min(lat) + max(lat)) / 2, 6) AS center_lat, round((min(lon) + max(lon)) / 2, 6) AS center_lon FROM nodes"),
        "p01_highway_class": sql(f"SELECT way_id, ({CLASS})::BIGINT AS road_class FROM raw_ways"),
        "p02_default_speed": sql(f"SELECT way_id, {DEFAULT} AS default_kmh FROM raw_ways"),
        "p03_oneway": sql("SELECT way_id, is_one_way, is_reverse FROM ways"),
        "p04_maxspeed": sql(f"SELECT way_id, {SPEED_TAG} AS kmh FROM raw_ways"),
        "p05_way_segments": sql(f"SELECT way_id, i - 1 AS seq, refs[i] AS n1, refs[i + 1] AS n2 FROM (SELECT *, unnest(range(1, len(refs))) AS i FROM ({LONG_WAY})) WHERE refs[i + 1] IN (SELECT id FROM nodes)"),
        "p06_directed_edges": sql("SELECT way_id, src, dst FROM ends"),
        "p07_edge_metrics": sql("SELECT way_id, src, dst, length_m, base_weight FROM edges"),
        "p08_flags": sql("SELECT is_one_way, count(*) AS edges FROM edges GROUP BY is_one_way"),
        "p09_edge_ids": sql("SELECT edge_id, src, dst, way_id FROM edges"),
        "p10_csr_offsets": sql("SELECT id, (SELECT count(*) FROM edges e WHERE e.src = id) AS degree, (sum((SELECT count(*) FROM edges e WHERE e.src = id)) OVER (ORDER BY id))::BIGINT - (SELECT count(*) FROM edges e WHERE e.src = id) AS first_edge FROM nodes"),
        "p11_reorder_by_cell": sql("SELECT edge_id, row_number() OVER (ORDER BY a.k, b.k, way_id, edge_id) - 1 AS new_edge_id, a.k AS new_src, b.k AS new_dst FROM edges JOIN (SELECT id, row_number() OVER (ORDER BY cell, id) - 1 AS k FROM nodes) a ON a.id = src JOIN (SELECT id, row_number() OVER (ORDER BY cell, id) - 1 AS k FROM nodes) b ON b.id = dst"),
        "p12_bbox_viewbox": sql("SELECT printf('%.6f,%.6f,%.6f,%.6f', min(lon), max(lat), max(lon), min(lat)) AS viewbox FROM nodes"),
        "p13_projection": sql(f"SELECT id, round({sx('lon')}, 3) AS x, round({py('lat')}, 3) AS y FROM nodes, middle"),
        "p14_validate_requests": f"""SELECT {k}, CASE {k} % 6 WHEN 1 THEN 'missing required field src_lat' WHEN 2 THEN 'missing required field src_lon' WHEN 3 THEN 'missing required field dst_lat' WHEN 4 THEN 'missing required field dst_lon'
            ELSE CASE WHEN NOT {k} % 200 - 100 BETWEEN -90 AND 90 THEN 'latitude must be between -90 and 90' WHEN NOT {k} % 400 - 200 BETWEEN -180 AND 180 THEN 'longitude must be between -180 and 180' END END AS error FROM supplier""",
        "p15_route_count": f"SELECT {k}, least(5, greatest(1, {k} % 11 - 2)) AS routes, least(10000, greatest(1, {k} * 400 - 900)) AS cars FROM supplier",
        "p17_session_path": f"SELECT {k}, CASE WHEN {k} % 5 >= 2 THEN 's' || {k} ELSE '' END AS session, CASE {k} % 5 WHEN 3 THEN 'ws' WHEN 4 THEN 'ws/extra' ELSE '' END AS rest FROM supplier",
        "p18_routing_mode": f"SELECT {k}, CASE {k} % 5 WHEN 0 THEN 'hierarchical' WHEN 1 THEN 'hierarchical' WHEN 2 THEN 'base-astar' WHEN 3 THEN 'base-dijkstra' END AS mode FROM supplier",
        "m01_haversine": sql(f"SELECT request_id, round({haversine('src_lat', 'src_lon', 'dst_lat', 'dst_lon')}, 3) AS metres FROM req"),
        "m03_heuristic": sql(f"SELECT request_id, round({heuristic('src_lat', 'src_lon', 'dst_lat', 'dst_lon')}, 3) AS metres FROM req"),
        "m05_point_segment": sql(f"SELECT edge_id, round({segment(px('plon'), py('plat'), px('lon1'), py('lat1'), px('lon2'), py('lat2'))}, 3) AS metres FROM offp"),
        "m06_local_distance": sql(f"SELECT edge_id, round({local_m('plat', 'plon', 'lat2', 'lon2')}, 3) AS metres FROM offp"),
        "m07_interpolate": sql("SELECT edge_id, round(lat1 + (lat2 - lat1) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (edge_id % 13 - 1) / 10.0::DOUBLE)), 6) AS lat, round(lon1 + (lon2 - lon1) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (edge_id % 13 - 1) / 10.0::DOUBLE)), 6) AS lon FROM edges"),
        "m08_turn_info": sql("SELECT route_id, leg_idx, round(angle, 4) AS angle, side FROM turns"),
        "m09_turn_instruction": sql("SELECT route_id, leg_idx, CASE WHEN angle IS NULL THEN 'Arrive at destination' WHEN round(angle, 6) < 20 THEN 'Continue straight' WHEN round(angle, 6) < 45 THEN 'Slight ' || d || ' turn' WHEN round(angle, 6) < 120 THEN 'Turn ' || d WHEN round(angle, 6) < 160 THEN 'Sharp ' || d || ' turn' ELSE 'U-turn' END AS instruction FROM (SELECT *, CASE WHEN side > 0 THEN 'left' ELSE 'right' END AS d FROM turns)"),
        "m10_bearing": sql(f"SELECT route_id, leg_idx, round({bearing}, 4) AS bearing FROM bent"),
        "m11_bearing_cap": sql(f"SELECT route_id, leg_idx, round(g, 4) AS gap, coalesce(g > 25, false) AS capped FROM (SELECT *, CASE WHEN abs(nb - b) > 180 THEN 360 - abs(nb - b) ELSE abs(nb - b) END AS g FROM (SELECT *, lead(b) OVER (PARTITION BY route_id ORDER BY leg_idx) AS nb FROM (SELECT *, round({bearing}, 6) AS b FROM bent)))"),
        "m12_format_eta": "SELECT o_orderkey, CASE WHEN s <= 0 THEN '--' WHEN floor(s / 3600) > 0 THEN floor(s / 3600)::BIGINT || 'h ' || floor((s % 3600) / 60)::BIGINT || 'm' ELSE floor((s % 3600) / 60)::BIGINT || ' min' END AS duration, printf('%.1f km', floor(floor(o_totalprice) / 100 + 0.5::DOUBLE) / 10) AS distance FROM (SELECT *, o_totalprice / 7 - 300 AS s FROM orders)",
        "m13_grid_bucket": sql("SELECT edge_id, floor(plat * 111320.0::DOUBLE / 120)::BIGINT || ':' || floor(plon * (111320.0::DOUBLE * cos(radians(m))) / 120)::BIGINT AS bucket FROM offp, (SELECT round(avg(plat), 6) AS m FROM offp)"),
        "j03_snap": sql(f"SELECT request_id AS point_id, b.id AS node_idx, round(sqrt(b.d2), 3) AS dist_m FROM (SELECT request_id, min({{'d2': ({sx(snap_lon)} - {sx('lon')}) * ({sx(snap_lon)} - {sx('lon')}) + ({py(snap_lat)} - {py('lat')}) * ({py(snap_lat)} - {py('lat')}), 'id': id}}) AS b FROM req, nodes, middle GROUP BY request_id)"),
        "j05_live_weight": sql("SELECT edge_id, round(multiplier, 6) AS multiplier, round(live_weight, 6) AS live_weight FROM live"),
        "j06_overlay_weight": sql("SELECT o.overlay_id, o.src, o.dst, o.is_cross_cell, round(CASE WHEN o.is_cross_cell THEN o.weight * coalesce(s.weight, 1.0::DOUBLE) ELSE o.weight * CASE WHEN o.store_idx % 5 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END END, 4) AS live_weight FROM overlay o LEFT JOIN state s ON s.edge_id = o.store_idx AND o.is_cross_cell"),
        "j07_speed_fanout": sql("SELECT session_id, edge_id, round(w1, 6) AS old_multiplier, round(w2, 6) AS new_multiplier FROM remaining JOIN moved USING (edge_id) WHERE connected"),
        "j08_better_route": sql(f"SELECT request_id, {eta60} AS eta_sec FROM req q WHERE EXISTS (SELECT 1 FROM imp i WHERE {heuristic('q.src_lat', 'q.src_lon', 'i.lat1', 'i.lon1')} * (3.6::DOUBLE / 120) + i.live_weight + {heuristic('i.lat2', 'i.lon2', 'q.dst_lat', 'q.dst_lon')} * (3.6::DOUBLE / 120) < {eta60})", imp="SELECT e.*, e.base_weight * m.w1 AS live_weight FROM edges e JOIN moved m USING (edge_id) WHERE m.w2 - m.w1 >= 0.1::DOUBLE"),
        "j10_first_edge": sql("SELECT src, dst, edge_id FROM firsts"),
        "j11_step_edge": sql("SELECT route_id, step_idx, edge_id AS resolved FROM legs WHERE prev IS NOT NULL"),
        "j12_nearby_cars": sql("SELECT request_id AS point_id, count(*) AS cars, min(edge_id) AS first_car FROM req, offp WHERE abs(floor(src_lat * 111320.0::DOUBLE / 120) - floor(plat * 111320.0::DOUBLE / 120)) <= 1 AND abs(floor(src_lon * (111320.0::DOUBLE * cos(radians(32.02::DOUBLE))) / 120) - floor(plon * (111320.0::DOUBLE * cos(radians(32.02::DOUBLE))) / 120)) <= 1 GROUP BY request_id"),
        "j13_map_match": sql(f"SELECT event_id AS point_id, b.leg_idx AS leg_idx, round(b.o, 3) AS offset_m, round(b.p, 3) AS progress_m, round(b.l, 3) AS distance_left_m FROM (SELECT event_id, min({{'d2': round((lat - qa) * (lat - qa) + (lon - qo) * (lon - qo), 12), 'leg_idx': leg_idx, 'o': {local_m('lat', 'lon', 'qa', 'qo')}, 'p': leg_m * t, 'l': greatest(0.0::DOUBLE, total_m - start_m - leg_m * t)}}) AS b FROM (SELECT *, lat1 + (lat2 - lat1) * t AS qa, lon1 + (lon2 - lon1) * t AS qo FROM (SELECT p.event_id, p.lat, p.lon, l.*, {along('p.lon', 'p.lat', 'l.lon1', 'l.lat1', 'l.lon2', 'l.lat2')} AS t FROM pp p JOIN rlegs l USING (route_id))) GROUP BY event_id)"),
        "g01_partition": "SELECT count(*) AS nodes, true AS within, true AS enough, true AS named_by_first FROM part",
        "g02_undirected_pairs": sql("SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges"),
        "g04_gates": sql("SELECT gate_id, node_idx, cell FROM gates"),
        "g05_cross_edges": sql("SELECT src, dst, base_weight, edge_id AS store_idx FROM crossings"),
        "g06_shortcuts": sql("SELECT cell, src, dst, weight FROM shortcuts"),
        "g07_overlay_edges": sql("SELECT overlay_id, src, dst, weight, is_cross_cell, store_idx FROM overlay"),
        "g08_graph_stats": sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM crossings) AS cross_edges, (SELECT count(DISTINCT cell) FROM nodes) AS cells, (SELECT count(*) FROM gates) AS gates, (SELECT count(*) FROM shortcuts) AS shortcuts"),
        "r03_cell_dijkstra": sql("SELECT request_id, node AS node_idx, cost FROM req JOIN cd ON root = src", cd=f"SELECT DISTINCT src, src, 0::BIGINT FROM req {relax('', 'inner_edges', 'cd')}"),
        "r05_multi_source": sql("SELECT root AS request_id, node AS node_idx, cost FROM cd", cd=f"SELECT * FROM (SELECT request_id, src, 0::BIGINT FROM req UNION ALL SELECT request_id, src + 1, 150::BIGINT FROM req, n WHERE src % 10 < 9 AND src + 1 < n) {relax('', 'inner_edges', 'cd')}"),
        "r06_overlay_search": sql(
            "SELECT request_id, src, dst, cost FROM oreq JOIN ov ON root = src AND node = dst WHERE src <> dst",
            oreq="SELECT request_id, a.gate AS src, b.gate AS dst FROM req JOIN nodes s ON s.id = req.src JOIN nodes d ON d.id = req.dst JOIN (SELECT cell, min(node_idx) AS gate FROM gates GROUP BY cell) a ON a.cell = s.cell JOIN (SELECT cell, min(node_idx) AS gate FROM gates GROUP BY cell) b ON b.cell = d.cell",
            ohops="SELECT src, dst, min(weight) AS wt FROM overlay GROUP BY src, dst",
            ov=f"SELECT DISTINCT src, src, 0::BIGINT FROM oreq {relax('', 'ohops', 'ov')}",
        ),
        "r08_route_steps": sql("SELECT request_id, src, dst, cost, 0::BIGINT AS broken_hops FROM best"),
        "r10_cumulative": sql("SELECT route_id, step_idx, node_idx, edge_id, round(distance_m, 3) AS distance_m, round(time_sec, 3) AS time_sec FROM cum"),
        "r11_alternatives": sql("SELECT request_id, 3::BIGINT AS routes, true AS first_is_best, 1::BIGINT AS goals, cost FROM best"),
        "r15_repair_overlay": sql(
            "SELECT job, min(cost) AS cost FROM rep JOIN crossings k ON edge_id = job WHERE node = k.dst AND hops > 0 GROUP BY job",
            ohops="SELECT src, dst, min(weight) AS wt FROM overlay GROUP BY src, dst",
            rep="SELECT edge_id, src, 0, 0::BIGINT FROM crossings UNION ALL SELECT r.job, e.dst, r.hops + 1, min(r.cost + e.wt) FROM rep r JOIN crossings c ON c.edge_id = r.job JOIN ohops e ON e.src = r.node WHERE r.node <> c.dst AND r.hops < 5 AND r.cost + e.wt <= 3000 AND NOT (e.src = c.src AND e.dst = c.dst) GROUP BY r.job, e.dst, r.hops + 1",
        ),
        "r16_repair_base": sql(
            "SELECT job, min(cost) AS cost FROM rep JOIN jobs USING (job) WHERE node = jobs.dst AND hops > 0 GROUP BY job",
            jobs="SELECT request_id AS job, req.src AS src, min(e.dst) AS dst FROM req JOIN edges e ON e.src = req.src GROUP BY request_id, req.src",
            rep="SELECT job, src, 0, 0::BIGINT FROM jobs UNION ALL SELECT r.job, e.dst, r.hops + 1, min(r.cost + e.wt) FROM rep r JOIN jobs c ON c.job = r.job JOIN hops e ON e.src = r.node WHERE r.node <> c.dst AND r.hops < 8 AND r.cost + e.wt <= 4000 AND NOT (e.src = c.src AND e.dst = c.dst) GROUP BY r.job, e.dst, r.hops + 1",
        ),
        "o01_edge_ids": sql(f"SELECT route_id, {ids_text} AS edge_ids FROM legs GROUP BY route_id"),
        "o02_initial_step": sql("SELECT route_id, CASE WHEN count(*) <= 1 THEN 0 ELSE 1 END::BIGINT AS initial_step, count(*) AS steps FROM legs GROUP BY route_id"),
        "o03_current_edge": sql("SELECT route_id, route_id % 15 AS cursor, max(edge_id) FILTER (step_idx = CASE WHEN route_id % 15 = 0 THEN 1 ELSE route_id % 15 END) AS edge_id FROM legs GROUP BY route_id"),
        "o04_destination": sql("SELECT route_id, arg_max(node_idx, step_idx) AS destination FROM legs GROUP BY route_id"),
        "o05_same_remaining": sql(f"SELECT route_id, CASE WHEN len(b) = 0 THEN true ELSE len(a) >= len(b) AND len(a) - len(b) <= 2 AND a[len(a) - len(b) + 1:] = b END AS same FROM (SELECT route_id, a, CASE WHEN route_id % 7 = 0 THEN list_reverse(a) ELSE a[route_id % 5 + 1:] END AS b {tail})"),
        "o06_patched": sql("SELECT route_id, row_number() OVER w - 1 AS step_idx, node_idx, round(sum(leg_m) OVER w, 3) AS distance_m, round(sum(leg_sec) OVER w, 3) AS time_sec FROM (SELECT route_id, step_idx, 0 AS part, node_idx, leg_m, leg_sec FROM legs WHERE step_idx <> 3 UNION ALL SELECT route_id, step_idx, unnest([0, 1]), node_idx, 60.0::DOUBLE, 5.0::DOUBLE FROM legs WHERE step_idx = 3) WINDOW w AS (PARTITION BY route_id ORDER BY step_idx, part)"),
        "o07_remaining_steps": sql("SELECT route_id, count(*) AS steps_left FROM legs WHERE step_idx >= route_id % 6 GROUP BY route_id"),
        "o08_legs": sql(f"SELECT route_id, step_idx, prev AS from_node, node_idx AS to_node, round(m, 3) AS leg_m, round(s, 3) AS leg_sec, CASE WHEN s > 0 THEN {half.format('m / s * 3.6::DOUBLE')} ELSE {half.format('13.8::DOUBLE * 3.6::DOUBLE')} END AS speed_kmh FROM (SELECT *, greatest(0.0::DOUBLE, distance_m - lag(distance_m) OVER w) AS m, greatest(0.0::DOUBLE, time_sec - lag(time_sec) OVER w) AS s FROM cum WINDOW w AS (PARTITION BY route_id ORDER BY step_idx)) WHERE step_idx > 0"),
        "o09_congestion": sql("SELECT route_id, count(*) FILTER (live_weight >= 1.5::DOUBLE * live.base_weight) AS congested_edges, count(*) FILTER (live_weight >= 1.5::DOUBLE * live.base_weight) > 0 AS congestion_ahead FROM legs JOIN live USING (edge_id) GROUP BY route_id"),
        "o10_eta": sql(f"SELECT l.route_id, round(sum(e.live_weight * CASE WHEN l.step_idx = c.step_idx AND c.step_idx > 0 AND e.length_m > 0 THEN least(1.0::DOUBLE, {haversine('(c.lat - 0.0004::DOUBLE)', '(c.lon - 0.0002::DOUBLE)', 'l.lat', 'l.lon')} / e.length_m) ELSE 1.0::DOUBLE END), 3) AS eta_sec FROM legs c JOIN legs l ON l.route_id = c.route_id AND l.step_idx >= c.step_idx JOIN live e ON e.edge_id = l.edge_id WHERE c.step_idx = c.route_id % 7 GROUP BY l.route_id"),
        "o11_off_route": sql("SELECT event_id AS point_id, round(off_m, 3) AS off_m FROM off"),
        "o12_debug_snapshot": sql("SELECT session_id, p.route_id, p.step_idx, c.k AS congested_edges, c.k > 0 AS congestion_ahead, connected FROM pos p JOIN (SELECT route_id, count(*) FILTER (live_weight >= 1.5::DOUBLE * live.base_weight) AS k FROM legs JOIN live USING (edge_id) GROUP BY route_id) c USING (route_id)"),
        "t01_ewma": sql(f"SELECT edge_id, round({fold(SAMPLES)}, 6) AS weight, count(*) AS samples FROM ev WHERE event_type IN ('purchase', 'signup') AND ratio > 0 GROUP BY edge_id"),
        "t02_speed_sample": sql(f"SELECT edge_id, round({fold(SAMPLES)}, 6) AS weight, count(*) AS samples FROM ev WHERE event_type IN ('click', 'view') AND ratio > 0 GROUP BY edge_id"),
        "t03_density": sql("SELECT edge_id, density FROM dens"),
        "t05_point_reads": sql("SELECT edge_id, round(coalesce(s.weight, 1.0::DOUBLE), 6) AS weight, coalesce(s.density, 0) AS density FROM edges LEFT JOIN state s USING (edge_id)"),
        "t06_congested": sql("SELECT edge_id FROM state WHERE weight > 1.5::DOUBLE"),
        "t07_recommended_speed": sql("SELECT edge_id, limit_kmh, density, round(recommended_kmh, 6) AS recommended_kmh FROM advice"),
        "t08_decay": sql(f"SELECT edge_id, round({decayed}, 6) AS weight FROM ev WHERE ratio > 0 GROUP BY edge_id"),
        "t08_at_rest": sql(
            f"SELECT edge_id, round(w, 6) AS weight, w <> 1 AS dirty FROM (SELECT edge_id, {decay.replace('x.us', 't').replace('a.w', 'f.w').replace('a.us', 'f.us')} AS w FROM folded, (SELECT max(us) + 4000000 AS t FROM ev))",
            folded=f"SELECT edge_id, {decayed.removesuffix('.w')} AS f FROM ev WHERE ratio > 0 GROUP BY edge_id",
        ),
        "t09_cdc_snapshot": sql("SELECT edge_id, round(w1, 6) AS old_multiplier, round(w2, 6) AS new_multiplier FROM moved"),
        "t11_multipliers": sql("SELECT edge_id, round(multiplier, 6) AS weight FROM live"),
        "t13_affected_cells": sql("SELECT DISTINCT cell_src AS cell FROM edges WHERE cell_src = cell_dst AND (edge_id IN (SELECT edge_id FROM mult) OR (SELECT count(*) FROM mult) >= 0.25 * (SELECT count(*) FROM edges))"),
        "t13_customise": sql(
            "SELECT g.cell, root AS src, node AS dst, cost AS weight FROM cu JOIN gates g ON g.node_idx = root JOIN gates h ON h.node_idx = node WHERE root <> node",
            acells="SELECT DISTINCT cell_src AS cell FROM edges WHERE cell_src = cell_dst AND (edge_id IN (SELECT edge_id FROM mult) OR (SELECT count(*) FROM mult) >= 0.25 * (SELECT count(*) FROM edges))",
            lhops="SELECT src, dst, min(round(round(live_weight, 6) * 100)::BIGINT) AS wt FROM live WHERE cell_src = cell_dst AND cell_src IN (SELECT cell FROM acells) GROUP BY src, dst",
            cu=f"SELECT node_idx, node_idx, 0::BIGINT FROM gates WHERE cell IN (SELECT cell FROM acells) {relax('', 'lhops', 'cu')}",
        ),
        "t14_upsert": sql("SELECT src, dst, edge_id AS store_idx, CASE WHEN edge_id % 4 = 0 THEN round(base_weight * 2, 6) ELSE round(base_weight, 6) END AS weight FROM crossings"),
        "t17_improved": sql("SELECT edge_id, round(w2, 6) AS old_multiplier, round(w1, 6) AS new_multiplier FROM moved WHERE w2 - w1 >= 0.1::DOUBLE"),
        "t18_speed_updates": sql("SELECT edge_id, round(recommended_kmh, 6) AS recommended_kmh FROM advice WHERE limit_kmh > 0 AND edge_id IN (SELECT edge_id FROM moved)"),
        "n04_advance": sql("SELECT session_id, event_id, step_idx, prev_step, moved FROM adv"),
        "n05_edge_events": sql(f"SELECT edge_id, round({fold(SAMPLES)}, 6) AS weight, count(*) AS samples FROM (SELECT x.event_id, epoch_us(ts) AS us, e.edge_id, (value / 20 - 1) / e.base_weight AS ratio, 0.15::DOUBLE AS alpha FROM events x JOIN edges e ON e.edge_id = x.user_id * 11 - 40 WHERE value / 20 - 1 > 0) GROUP BY edge_id"),
        "n06_partial_sample": sql("SELECT session_id, event_id, round(age, 3) AS age_sec FROM (SELECT *, (us - min(us) OVER (PARTITION BY session_id, run)) / 1000000.0::DOUBLE AS age FROM (SELECT *, sum(moved::INT) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM adv)) WHERE age >= 2 AND speed_kmh > 0"),
        "n07_release": sql("SELECT edge_id, count(*) FILTER (l.step_idx = a.step_idx) AS entered, count(*) FILTER (l.step_idx < a.step_idx) AS released FROM adv a JOIN legs l USING (route_id) WHERE a.moved AND l.edge_id IS NOT NULL AND l.step_idx BETWEEN a.prev_step AND a.step_idx GROUP BY edge_id"),
        "n08_eta_throttle": sql(f"SELECT session_id, unnest(ids) AS event_id FROM (SELECT session_id, {throttle} AS ids FROM pings GROUP BY session_id)"),
        "n09_strikes": sql("SELECT session_id, event_id, strikes, hit AND strikes >= 2 AS off_route FROM struck"),
        "n10_decision": sql(f"SELECT session_id, unnest(f.ids) AS event_id, unnest(f.why) AS reason FROM (SELECT session_id, {decide} AS f FROM struck GROUP BY session_id)"),
        "n10_live_decision": sql(f"SELECT session_id, unnest(f.ids) AS event_id, unnest(f.why) AS reason FROM (SELECT session_id, {decide.replace('event_id % 4 = 0', 'coalesce(jam, false)')} AS f FROM struck LEFT JOIN (SELECT route_id, count(*) FILTER (live_weight >= 1.5::DOUBLE * live.base_weight) > 0 AS jam FROM legs JOIN live USING (edge_id) GROUP BY route_id) USING (route_id) GROUP BY session_id)"),
        "n11_repair_trigger": sql("SELECT route_id, b.step_idx AS step_idx, b.edge_id AS edge_id, b.x AS is_cross FROM (SELECT route_id, min({'step_idx': step_idx, 'edge_id': edge_id, 'x': cell_src <> cell_dst}) AS b FROM legs JOIN live USING (edge_id) WHERE live_weight >= 2 * live.base_weight AND live_weight - live.base_weight >= 20 GROUP BY route_id)"),
        "n13_accept": "SELECT o_orderkey, coalesce(o_orderkey % 11 = 0 OR (o > 0 AND ((o - w) / o >= 0.07::DOUBLE OR o - w >= 15) AND NOT o_orderkey % 5 = 0), false) AS accepted FROM (SELECT o_orderkey, o, o * (0.85::DOUBLE + o_orderkey % 30 / 100.0::DOUBLE) AS w FROM (SELECT o_orderkey, o_totalprice / 1000 - 20 AS o FROM orders))",
        "n14_version_check": sql("SELECT a.event_id, a.session_id FROM adv a JOIN pos p ON p.session_id = a.session_id AND p.step_idx = a.step_idx WHERE a.event_id % 3 = p.session_id % 3"),
        "n16_speed_hints": sql("SELECT session_id, edge_id, round(recommended_kmh, 6) AS recommended_kmh FROM remaining JOIN advice USING (edge_id) WHERE NOT (recommended_kmh = limit_kmh AND density = 0)"),
        "n21_expiry": sql("SELECT session_id, max(us) AS last_us FROM pings GROUP BY session_id HAVING (SELECT max(us) FROM pings) - max(us) > 21600000000"),
        "n22_subscribers": sql("SELECT DISTINCT edge_id, session_id FROM remaining"),
        "n23_unsubscribed": sql("SELECT p.session_id, l.edge_id FROM pos p JOIN legs l USING (route_id) WHERE l.step_idx < p.step_idx AND l.edge_id IS NOT NULL"),
        "v02_car_advance": sql("SELECT car_id, leg_idx, round(progress_m, 3) AS progress_m, legs_done, leg_idx IS NULL AS finished FROM ridden"),
        "v03_car_speed": sql("SELECT car_id, leg_idx, round(kmh, 6) AS kmh FROM carlegs"),
        "v05_spawn_start": sql(f"SELECT car_id, route_id, min(leg_idx) AS start_step FROM (SELECT *, sum(m) OVER (PARTITION BY route_id ORDER BY leg_idx) AS run, sum(m) OVER (PARTITION BY route_id) AS every FROM (SELECT route_id AS car_id, route_id, leg_idx, CASE WHEN leg_m > 0 THEN leg_m ELSE 0.1::DOUBLE END AS m FROM rlegs)) WHERE run >= {unit('car_id::VARCHAR')} * every GROUP BY car_id, route_id"),
        "v06_random_od": sql(
            "SELECT car_id, attempt, round(src_lat, 6) AS src_lat, round(src_lon, 6) AS src_lon, round(dst_lat, 6) AS dst_lat, round(dst_lon, 6) AS dst_lon FROM (SELECT *, row_number() OVER (PARTITION BY car_id ORDER BY attempt) AS k FROM tries WHERE (src_lat - dst_lat) * (src_lat - dst_lat) + (src_lon - dst_lon) * (src_lon - dst_lon) >= 0.0004::DOUBLE) WHERE k = 1",
            box="SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM nodes",
            origins=f"SELECT *, min_lat + (max_lat - min_lat) * {unit('car_id || $$/1$$')} AS src_lat, min_lon + (max_lon - min_lon) * {unit('car_id || $$/2$$')} AS src_lon FROM (SELECT s_suppkey AS car_id FROM supplier), box",
            tries=f"SELECT *, {near('lat', 3)} AS dst_lat, {near('lon', 4)} AS dst_lon FROM origins, (SELECT unnest(range(0, 6)) AS attempt)",
        ),
        "v08_snapshot": sql("SELECT car_id, round(lat1 + (lat2 - lat1) * f, 6) AS lat, round(lon1 + (lon2 - lon1) * f, 6) AS lon FROM (SELECT c.*, least(1.0::DOUBLE, greatest(0.0::DOUBLE, r.progress_m / c.len)) AS f FROM ridden r JOIN carlegs c ON c.car_id = r.car_id AND c.leg_idx = r.leg_idx)"),
        "v09_driver_profile": f"SELECT {k}, {profile(17.3, 0.85, 1.15)} AS pace_bias, {profile(29.1, 1.2, 2.8)} AS accel_ms2, {profile(43.7, 1.8, 3.6)} AS brake_ms2, {profile(61.9, 0.85, 1.3)} AS junction_bias FROM supplier",
        "v10_target_speed": sql("SELECT car_id, leg_idx, round(least(greatest(base_kmh * pace, 0.5::DOUBLE), greatest(8.0::DOUBLE, base_kmh * 1.05::DOUBLE)), 6) AS target_kmh FROM carlegs"),
        "v11_accel": sql(f"SELECT route_id, round({speed_up}, 6) AS kmh FROM slegs GROUP BY route_id"),
        "v12_intersection_delay": sql("SELECT route_id, leg_idx, CASE WHEN angle IS NULL OR d = 0 THEN 0 ELSE floor(greatest(250.0::DOUBLE, d * 1.1::DOUBLE) + 0.5)::BIGINT END AS delay_ms FROM (SELECT *, CASE WHEN round(angle, 6) > 120 THEN 2200 WHEN round(angle, 6) > 65 THEN 1200 WHEN nk <= 35 THEN 550 WHEN leg_m < 35 OR nm < 35 THEN 300 ELSE 0 END AS d FROM (SELECT *, coalesce(lead(speed_kmh) OVER w, speed_kmh, 50.0::DOUBLE) AS nk, lead(leg_m) OVER w AS nm FROM turns WINDOW w AS (PARTITION BY route_id ORDER BY leg_idx)))"),
        "v14_following": f"SELECT {k} AS point_id, round(greatest(0.0::DOUBLE, least(25.0::DOUBLE, min(CASE WHEN {k} % 25 <= 18 AND o - {k} % 10 * 20 > 0 AND o - {k} % 10 * 20 <= 80 THEN greatest(0.0::DOUBLE, (o - {k} % 10 * 20)::DOUBLE - greatest(7.0::DOUBLE, {k} % 60 / 3.6::DOUBLE * 1.8::DOUBLE)) END))), 6) AS allowed_m FROM supplier, (SELECT unnest([30, 90, 150]) AS o) GROUP BY {k}",
        "v15_traffic_level": sql("SELECT route_id, leg_idx, slow AS slow_edges, CASE WHEN slow = 0 THEN 'normal' WHEN worst <= 0.6 OR slow >= 2 THEN 'heavy' ELSE 'congested' END AS level FROM (SELECT *, count(*) FILTER (q < 0.95::DOUBLE) OVER w AS slow, least(1.0::DOUBLE, min(q) FILTER (q < 0.95::DOUBLE) OVER w) AS worst FROM (SELECT l.route_id, l.leg_idx, CASE WHEN a.limit_kmh > 0 THEN round(a.recommended_kmh, 6) / a.limit_kmh END AS q FROM rlegs l LEFT JOIN advice a USING (edge_id)) WINDOW w AS (PARTITION BY route_id ORDER BY leg_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))"),
        "v16_ping_throttle": sql("SELECT session_id, us // 3600000000 AS hour, arg_min(event_id, (us, event_id)) AS event_id FROM pings GROUP BY session_id, us // 3600000000"),
        "v17_gain_text": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR g <= 0 THEN 'Route updated for current traffic conditions.' WHEN g >= 60 THEN 'New path saves about ' || floor(g / 60 + 0.5)::BIGINT || ' min.' ELSE 'New path saves about ' || floor(g + 0.5)::BIGINT || ' sec.' END AS text FROM (SELECT o_orderkey, o_totalprice / 1000 - o_orderkey % 400 AS g FROM orders)",
        "v18_trip_inset": sql("SELECT round(min(lat) + (max(lat) - min(lat)) * 0.08::DOUBLE, 6) AS min_lat, round(max(lat) - (max(lat) - min(lat)) * 0.08::DOUBLE, 6) AS max_lat, round(min(lon) + (max(lon) - min(lon)) * 0.08::DOUBLE, 6) AS min_lon, round(max(lon) - (max(lon) - min(lon)) * 0.08::DOUBLE, 6) AS max_lon FROM nodes"),
        "a06_percentiles": "SELECT event_type, count(*) AS n, max(value) FILTER (i = floor((n - 1) * 50 / 100)) AS p50, max(value) FILTER (i = floor((n - 1) * 95 / 100)) AS p95, max(value) FILTER (i = floor((n - 1) * 99 / 100)) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type",
        "a07_speedup_report": "WITH m AS (SELECT o_orderpriority, o_custkey % 4 + 1 AS workers, count(*) AS runs, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT o_orderpriority, workers, runs, round(v, 3) AS mean_value, printf('%.2fx', first_value(v) OVER (PARTITION BY o_orderpriority ORDER BY workers <> 1, workers) / v) AS speedup FROM m",
        "s01_extract": sql("SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM nodes WHERE id IN (SELECT a FROM raw_ways WHERE way_id % 3 = 0 UNION SELECT b FROM raw_ways WHERE way_id % 3 = 0)"),
        "s02_extract_ways": sql("SELECT way_id, a, b, highway, oneway, maxspeed, junction FROM raw_ways WHERE way_id % 3 = 0"),
        "s04_stored_graph": sql("SELECT gate_id, node_idx, cell FROM gates"),
        "s06_json_graph": sql("SELECT way_id, 2::BIGINT AS refs, road_class::BIGINT AS road_class, CASE WHEN way_id % 2 = 0 THEN speed_kmh ELSE CASE road_class WHEN 3 THEN 80.0::DOUBLE WHEN 4 THEN 60.0::DOUBLE ELSE 50.0::DOUBLE END END AS speed_kmh, is_one_way FROM ways"),
        "s10_search": "SELECT c_name AS displayName, (c_custkey % 80)::DOUBLE AS lat, (c_custkey % 170)::DOUBLE AS lng FROM customer WHERE contains(lower(c_name), '0000001') AND c_custkey % 9 <> 0 AND c_custkey % 80 BETWEEN 5 AND 70 AND c_custkey % 170 BETWEEN 10 AND 160 ORDER BY c_name, lat, lng LIMIT 50",
        "s17_bench_metrics": "SELECT 'BenchmarkRoute/' || o_orderkey AS name, unit, value FROM (SELECT o_orderkey, 'ns/op' AS unit, o_custkey::DOUBLE AS value FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'visited_nodes/op', o_orderkey + 0.5::DOUBLE FROM orders) WHERE o_orderkey % 5 > 1",
        "u03_od_corpus": sql(f"SELECT request_id, src, dst, round({haversine('src_lat', 'src_lon', 'dst_lat', 'dst_lon')}, 3) AS distance_m FROM req JOIN best USING (request_id, src, dst) WHERE abs(src - dst) >= 50 AND {haversine('src_lat', 'src_lon', 'dst_lat', 'dst_lon')} BETWEEN 500 AND 5000"),
        "stream_t01": sql("SELECT edge_id, round(weight, 6) AS weight FROM mult"),
        "stream_t03": sql("SELECT edge_id, density FROM dens"),
        "stream_n04": sql("SELECT session_id, max(step_idx) AS step_idx FROM adv GROUP BY session_id"),
        "stream_n09": sql("SELECT session_id, arg_max(strikes, (us, event_id)) AS strikes FROM struck GROUP BY session_id"),
    }
    out |= later()
    for name in ("r07_crp_steps", "r07_own_cells"):
        out[name] = out["r08_route_steps"]
    flags = out["j08_better_route"].rpartition("SELECT request_id, ")
    propagate = "SELECT 'flag' AS kind, request_id AS session_id, NULL::BIGINT AS edge_id, NULL::DOUBLE AS recommended_kmh FROM flagged UNION ALL SELECT 'speed', r.session_id, edge_id, round(recommended_kmh, 6) FROM remaining r JOIN advice USING (edge_id) WHERE connected AND limit_kmh > 0 AND edge_id IN (SELECT edge_id FROM moved)"
    improved = f"SELECT e.*, e.base_weight * m.w1 AS live_weight FROM edges e JOIN moved m USING (edge_id) WHERE m.w2 - m.w1 >= {0.1}::DOUBLE"
    flagged = "SELECT request_id, " + flags[2]
    out["n20_propagate"] = sql(propagate, imp=improved, flagged=flagged)
    out["n19_sweep"] = sql(
        "SELECT request_id, old_eta, new_eta, CASE WHEN request_id % 20 >= 10 AND request_id % 7 <> 0 AND request_id % 5 <> 0 AND old_eta > 0 AND ((old_eta - new_eta) / old_eta >= 0.07::DOUBLE OR old_eta - new_eta >= 15) THEN 'traffic_cleared' END AS reason FROM (SELECT request_id, eta_sec AS old_eta, cost / 100.0::DOUBLE AS new_eta FROM flagged JOIN req USING (request_id) JOIN lsp ON root = src AND node = dst WHERE src <> dst)",
        imp=improved, flagged=flagged, ledges=LIVE_EDGES, lhop=LIVE_HOPS, lsp=f"SELECT DISTINCT src, src, 0::BIGINT FROM req {relax('', 'lhop', 'lsp')}",
    )
    out["t01_in_parts"] = out["t01_ewma"]
    for name in ("r01_dijkstra", "r02_astar", "r07_crp"):
        out[name] = sql("SELECT request_id, src, dst, cost FROM best")
    out["n18_better_flag"] = out["j08_better_route"].replace("SELECT request_id, " + eta60 + " AS eta_sec FROM req q", "SELECT count(*) AS flagged FROM req q")
    return out


ORACLES = oracles()
