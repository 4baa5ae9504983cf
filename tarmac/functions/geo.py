"""Geometry as column expressions: all of it stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.schema import EARTH_RADIUS_M, GRID_BUCKET_M, KMH_PER_MPS, METERS_PER_DEGREE


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def project(lat: Column, lon: Column, ref_lat: Column) -> tuple[Column, Column]:
    """Equirectangular metres about a reference latitude."""
    return F.radians(lon) * F.cos(F.radians(ref_lat)) * EARTH_RADIUS_M, F.radians(lat) * EARTH_RADIUS_M


def heuristic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres about the destination's latitude."""
    dx = F.radians(lon2 - lon1) * F.cos(F.radians(lat2))
    dy = F.radians(lat2 - lat1)
    return F.sqrt(dx * dx + dy * dy) * EARTH_RADIUS_M


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def unit_clamp(t: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def along_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Place of the nearest point on a-b, from 0 at a to 1 at b; 0 if a = b."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    return F.when(squared > 0, unit_clamp(((px - ax) * dx + (py - ay) * dy) / squared)).otherwise(F.lit(0.0))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of p from the segment a-b."""
    t = along_segment(px, py, ax, ay, bx, by)
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def local_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres by degrees about the mean latitude."""
    dy = (lat1 - lat2) * METERS_PER_DEGREE
    dx = (lon1 - lon2) * METERS_PER_DEGREE * F.cos(F.radians((lat1 + lat2) * 0.5))
    return F.sqrt(dx * dx + dy * dy)


def turn_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two leg vectors; 0 where one has no length."""
    ma, mb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ax * bx + ay * by) / (ma * mb)))
    return F.when((ma == 0) | (mb == 0), F.lit(0.0)).otherwise(F.degrees(F.acos(cosine)))


def turn_side(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 left, -1 right (or straight), 0 where a leg has no length."""
    flat = ((ax == 0) & (ay == 0)) | ((bx == 0) & (by == 0))
    return F.when(flat, 0).when(ax * by - ay * bx > 0, 1).otherwise(-1)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.degrees(F.atan2(lon2 - lon1, lat2 - lat1))


def bearing_gap(a: Column, b: Column) -> Column:
    """Difference of two bearings, folded to at most 180."""
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d)


def grid_bucket(lat: Column, lon: Column, mean_lat: Column) -> tuple[Column, Column]:
    """Row and column of a grid of GRID_BUCKET_M squares."""
    per_lon = METERS_PER_DEGREE * F.cos(F.radians(mean_lat))
    return F.floor(lat * METERS_PER_DEGREE / GRID_BUCKET_M), F.floor(lon * per_lon / GRID_BUCKET_M)


def travel_sec(length_m: Column, speed_kmh: Column) -> Column:
    return length_m / (speed_kmh / KMH_PER_MPS)
