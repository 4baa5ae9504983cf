"""Traffic and driver formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac import schema as S


def ewma(samples: Column) -> Column:
    """Fold an ordered array<struct<ratio, alpha>> into a multiplier, from 1 and never below 1.

    Ratios under 1 count as 1; ratios that aren't positive are skipped.
    """
    step = lambda w, x: F.when(x["ratio"] > 0, F.greatest(F.lit(1.0), x["alpha"] * F.greatest(F.lit(1.0), x["ratio"]) + (1 - x["alpha"]) * w)).otherwise(w)
    return F.aggregate(samples, F.lit(1.0), step)


def density(deltas: Column) -> Column:
    """Fold an ordered array of +1/-1 into a count that never falls below 0."""
    return F.aggregate(deltas, F.lit(0).cast("long"), lambda d, x: F.greatest(F.lit(0).cast("long"), d + x))


def decayed(weight: Column, ticks: Column) -> Column:
    """A multiplier after so many decay ticks; below the tolerance it is exactly 1."""

    def step(w: Column, _: Column) -> Column:
        nearer = 1 + (w - 1) * S.DECAY_FACTOR
        return F.when(F.abs(nearer - 1) < S.DECAY_TOLERANCE, F.lit(1.0)).otherwise(nearer)

    return F.when(ticks > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(ticks, F.lit(1))), weight, step)).otherwise(weight)


def recommended_kmh(speed_kmh: Column, veh: Column, length_m: Column) -> Column:
    """Greenshields: free speed down to MIN_SPEED_RATIO of it at jam density."""
    per_km = veh / F.greatest(length_m / 1000, F.lit(S.MIN_EDGE_KM))
    low = speed_kmh * S.MIN_SPEED_RATIO
    open_road = (speed_kmh <= 0) | (veh <= 1)
    between = F.least(speed_kmh, F.greatest(low, low + (speed_kmh - low) * (1 - per_km / S.JAM_VEH_PER_KM)))
    return F.when(open_road, speed_kmh).when(per_km >= S.JAM_VEH_PER_KM, low).otherwise(between)


def car_kmh(base_kmh: Column, pace: Column) -> Column:
    """Speed of a simulated car: paced, at least MIN_CAR_KMH, then at most a tenth above the road's."""
    return F.least(F.greatest(base_kmh * pace, F.lit(S.MIN_CAR_KMH)), base_kmh * S.MAX_CAR_FACTOR)


def profile_value(seed: Column, name: str) -> Column:
    """One parameter of a driver, from the seed."""
    low, high = S.PROFILE_RANGES[name]
    return low + (high - low) * (F.abs(F.sin(seed * S.PROFILE_SEEDS[name])) % 1)


def target_kmh(base_kmh: Column, pace: Column) -> Column:
    return F.least(F.greatest(base_kmh * pace, F.lit(0.5)), F.greatest(F.lit(8.0), base_kmh * 1.05))


def next_kmh(now_kmh: Column, target: Column, elapsed_ms: Column, accel: Column, brake: Column) -> Column:
    """Speed after a step bounded by acceleration or braking."""
    delta = (target - now_kmh) / S.KMH_PER_MPS
    most = F.when(delta >= 0, accel).otherwise(brake) * elapsed_ms / 1000
    moved = F.greatest(-most, F.least(most, delta))
    return F.greatest(F.lit(0.0), (now_kmh / S.KMH_PER_MPS + moved) * S.KMH_PER_MPS)


def intersection_delay_ms(angle: Column, next_kmh: Column, length_m: Column, next_length_m: Column, bias: Column) -> Column:
    delay = F.when(angle > 120, 2200).when(angle > 65, 1200).when(next_kmh <= 35, 550).when((length_m < 35) | (next_length_m < 35), 300).otherwise(0)
    return F.when(angle.isNull() | (delay == 0), F.lit(0)).otherwise(F.floor(F.greatest(F.lit(250.0), delay * bias) + 0.5)).cast("long")


def safety_gap_m(speed_kmh: Column) -> Column:
    return F.greatest(F.lit(S.MIN_GAP_M), speed_kmh / S.KMH_PER_MPS * S.FOLLOW_SEC)


def gain_accepted(old_eta: Column, new_eta: Column, same_remaining: Column, local_patch: Column) -> Column:
    """Whether a candidate route is worth taking."""
    gain = old_eta - new_eta
    worth = (old_eta > 0) & ((gain / old_eta >= S.MIN_GAIN_RATIO) | (gain >= S.MIN_GAIN_SEC)) & ~same_remaining
    return F.coalesce(local_patch | worth, F.lit(False))
