"""Schemas and constants of the road-network model (fixed values)."""

from __future__ import annotations

EARTH_RADIUS_M = 6_371_000.0
KMH_PER_MPS = 3.6
REFERENCE_LATITUDE = 31.5
METERS_PER_DEGREE = 111_320.0

#: Tag of a way -> road class, 1 motorway ... 8 unclassified.
HIGHWAY_CLASS = {
    "motorway": 1,
    "motorway_link": 1,
    "trunk": 2,
    "trunk_link": 2,
    "primary": 3,
    "primary_link": 3,
    "secondary": 4,
    "secondary_link": 4,
    "tertiary": 5,
    "tertiary_link": 5,
    "residential": 6,
    "service": 7,
    "unclassified": 8,
}
#: Road class -> speed in km/h where the map states none.
DEFAULT_SPEED_KMH = {1: 120.0, 2: 100.0, 3: 80.0, 4: 60.0, 5: 50.0, 6: 50.0, 7: 20.0, 8: 50.0}
FLAG_ONE_WAY = 1

EWMA_ALPHA, SAMPLE_ALPHA = 0.15, 0.08
CONGESTED = 1.5
SIGNIFICANT_SHIFT = 0.10
DECAY_FACTOR, DECAY_TOLERANCE, DECAY_EVERY_SEC = 0.5, 0.05, 2.0
DIRTY_COVERAGE = 0.25
JAM_VEH_PER_KM, MIN_SPEED_RATIO, MIN_EDGE_KM = 120.0, 0.02, 0.02

OFF_ROUTE_M, OFF_ROUTE_SANITY_M, OFF_ROUTE_WINDOW, OFF_ROUTE_STRIKES = 50.0, 5000.0, 2, 2
SESSION_EXPIRY_SEC, ETA_THROTTLE_SEC, REROUTE_COOLDOWN_SEC, PARTIAL_EDGE_AGE_SEC = 300, 2, 10, 2.0
MIN_GAIN_RATIO, MIN_GAIN_SEC = 0.07, 15.0
SEVERE_RATIO, SEVERE_DELAY_SEC = 2.0, 20.0
OVERLAY_REPAIR_HOPS, BASE_REPAIR_HOPS = 5, 20
HEURISTIC_KMH = 120.0
#: Room of a session's outbound buffer; ticks of the simulation caught up at once; seconds on an edge before a sample, and between two.
OUTBOX, CATCH_UP_TICKS, SAMPLE_WARMUP_SEC, SAMPLE_EVERY_SEC = 256, 4, 1.0, 1.0
SUFFIX_OFFSET = 2

ASTAR_KMH, ALTERNATIVE_PENALTY = 250.0, 5.0
SNAP_GRID = 128
PARTITION_SEED, QUARTER = 42, 4

TICK_SEC, MIN_LEG_M, DEFAULT_LEG_KMH, MIN_CAR_KMH, MAX_CAR_FACTOR = 0.25, 0.1, 50.0, 8.0, 1.1
PACE_LOW, PACE_SPAN = 0.85, 0.30
MIN_OD_SQUARED, COMMUTE_DEG = 4e-4, 0.25
MIN_SPAWN, MAX_SPAWN, MAX_ROUTES = 1, 10_000, 5
ROUTE_CACHE_MINUTES = 30

#: Driver model of the client.
DEFAULT_LEG_MPS = 13.8
FOLLOW_SEC, MIN_GAP_M, TRACKED_GAP_M, CAPTURE_M = 1.8, 7.0, 80.0, 18.0
PROFILE_SEEDS = {"pace_bias": 17.3, "accel_ms2": 29.1, "brake_ms2": 43.7, "junction_bias": 61.9}
PROFILE_RANGES = {"pace_bias": (0.85, 1.15), "accel_ms2": (1.2, 2.8), "brake_ms2": (1.8, 3.6), "junction_bias": (0.85, 1.3)}
GRID_BUCKET_M = 120.0

NODES = "node_idx long, lat double, lon double, x double, y double, cell_id long"
EDGES = "edge_id long, src long, dst long, base_weight double, length_m double, speed_kmh double, flags int, cell_src long, cell_dst long"
PING = "type string, lat double, lon double, speed_kmh double, step_index int, edge_events array<struct<edge_id:long,observed_sec:double>>"
GRAPH_JSON = "nodes array<struct<id:long,lat:double,lon:double>>, ways array<struct<id:long,node_refs:array<long>,road_class:int,is_one_way:boolean,max_speed:double>>"
