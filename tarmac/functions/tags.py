"""Map tags, requests and display text as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.schema import DEFAULT_SPEED_KMH, HIGHWAY_CLASS, MAX_ROUTES, MAX_SPAWN, MIN_SPAWN


#: Texts of turns, with the side put in (fixed values).
TURN_TEXTS = {
    "destination": "Arrive at destination",
    "straight": "Continue straight",
    "slight": "Slight %s turn",
    "turn": "Turn %s",
    "sharp": "Sharp %s turn",
    "u-turn": "U-turn",
}
#: Fixed text where a reroute's gain isn't known.
UPDATED_TEXT = "Route updated for current traffic conditions."


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def road_class(highway: Column) -> Column:
    """Class of a highway tag, null where the way is no road of ours."""
    return literal_map(HIGHWAY_CLASS)[highway]


def default_speed(klass: Column) -> Column:
    return F.coalesce(literal_map(DEFAULT_SPEED_KMH)[klass], F.lit(DEFAULT_SPEED_KMH[8]))


def one_way(oneway: Column, junction: Column) -> tuple[Column, Column]:
    """(one way, reversed) of a way's tags."""
    tag = F.lower(F.trim(F.coalesce(oneway, F.lit(""))))
    forward, backward, both = tag.isin("yes", "true", "1"), tag.isin("-1", "reverse"), tag.isin("no", "false", "0")
    circle = F.lower(F.trim(F.coalesce(junction, F.lit("")))) == "roundabout"
    return F.when(forward | backward, True).when(both, False).otherwise(circle), backward


def max_speed(tag: Column) -> Column:
    """Leading number of a maxspeed tag, whatever its unit; 0 where there is none."""
    number = F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1)
    value = F.coalesce(number.try_cast("double"), F.lit(0.0))
    return F.when(value > 0, value).otherwise(F.lit(0.0))


def request_error(src_lat: Column, src_lon: Column, dst_lat: Column, dst_lon: Column) -> Column:
    """The first failing rule of a route request, null if there is none."""
    fields = {"src_lat": src_lat, "src_lon": src_lon, "dst_lat": dst_lat, "dst_lon": dst_lon}
    error = F.lit(None).cast("string")
    for lo, hi, axis, cols in ((-180, 180, "longitude", (src_lon, dst_lon)), (-90, 90, "latitude", (src_lat, dst_lat))):
        outside = ~cols[0].between(lo, hi) | ~cols[1].between(lo, hi)
        error = F.when(outside, F.lit(f"{axis} must be between {lo} and {hi}")).otherwise(error)
    for name, col in reversed(fields.items()):
        error = F.when(col.isNull(), F.lit(f"missing required field {name}")).otherwise(error)
    return error


def route_count(alternatives: Column) -> Column:
    return F.least(F.lit(MAX_ROUTES), F.greatest(F.lit(1), 1 + F.coalesce(alternatives, F.lit(0))))


def spawn_count(count: Column) -> Column:
    return F.least(F.lit(MAX_SPAWN), F.greatest(F.lit(MIN_SPAWN), F.coalesce(count, F.lit(MIN_SPAWN))))


def session_path(path: Column) -> tuple[Column, Column]:
    """(session id, rest) of ``/session/{id}[/{rest}]``; empty where absent."""
    tail = F.when(F.startswith(path, F.lit("/session/")), F.substring(path, 10, 1_000_000)).otherwise("")
    parts = F.split(tail, "/", 2)
    return parts[0], F.coalesce(F.get(parts, 1), F.lit(""))


def routing_mode(text: Column) -> Column:
    """Canonical mode; null for an unknown one (``routing_mode_error`` says why)."""
    mode = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(mode == "", "hierarchical").when(mode.isin("hierarchical", "base-astar", "base-dijkstra"), mode)


def routing_mode_error(text: Column) -> Column:
    """What is wrong with a mode; null for a known one."""
    return F.when(routing_mode(text).isNull(), F.concat(F.lit('unknown routing mode "'), F.trim(text), F.lit('"')))


def default_viewbox(asked: Column, viewbox: Column) -> Column:
    """The viewbox of a place search: the one asked for, else that of the graph."""
    return F.coalesce(F.when(F.trim(asked) != "", F.trim(asked)), viewbox)


def lat_lon(query: Column) -> tuple[Column, Column]:
    """Coordinates of a ``lat, lon`` query; null where it is none or out of range."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
    lat, lon = (F.regexp_extract(query, pattern, k).try_cast("double") for k in (1, 2))
    valid = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(valid, lat), F.when(valid, lon)


def duration_text(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    whole = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))
    return F.when(seconds.isNull() | (seconds <= 0), "--").otherwise(whole)


def gain_text(old_eta: Column, new_eta: Column, unknown: str = "Route updated") -> Column:
    """What a reroute gains; ``unknown`` where that isn't known or nothing (the client says UPDATED_TEXT)."""
    gain = F.greatest(F.lit(0.0), old_eta - new_eta)
    say = lambda n, unit: F.concat(F.lit("New path saves about "), F.floor(n + 0.5).cast("long").cast("string"), F.lit(unit))
    return F.when(old_eta.isNull() | new_eta.isNull() | (gain <= 0), unknown).when(gain >= 60, say(gain / 60, " min.")).otherwise(say(gain, " sec."))


def turn_text(angle: Column, side: Column) -> Column:
    """Instruction of a turn; null legs mean the destination."""
    name = F.when(side > 0, "left").otherwise("right")
    say = lambda kind: F.format_string(TURN_TEXTS[kind], name) if "%s" in TURN_TEXTS[kind] else F.lit(TURN_TEXTS[kind])
    return (
        F.when(angle.isNull(), say("destination")).when(angle < 20, say("straight")).when(angle < 45, say("slight"))
        .when(angle < 120, say("turn")).when(angle < 160, say("sharp")).otherwise(say("u-turn"))
    )
