"""Trajectories: track selection, step distances, thinning, trips, heads.

Sequence operators (previous point, next point) are window functions over
one track in time order.  A track can be arbitrarily long, so windows are
partitioned by (track, time chunk) instead of track alone.  What a chunk's
first or last row needs from the neighbouring chunk comes from an aggregate
with one row per (track, chunk), which combines map-side: the points are
windowed and sorted once.  The result is identical to an unchunked window
and no task ever holds more than one chunk of one track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.casting import round_half_even, round_half_up, to_mph
from tracklens.functions.classes import type_partial
from tracklens.functions.geo import haversine_m
from tracklens.functions.timefn import epoch_ms, epoch_us, is_ntz
from tracklens.functions.zones import zones_loader
from tracklens.params import PLAYBACK_STEP_MS, TRAIL_LENGTH_MS, ThinParams

TRACK = "track_identifier"
ORDER = ["timestamp", "event_id"]
DEFAULT_CHUNK_MS = 3_600_000
# the chunk of rows without a time: they come first, as NULLs do in the order of a window
NO_TIME = -(1 << 62)
# rows without a track id belong together, so their chunks are shorter
NULL_CHUNKS = 60


def first_tracks(det: DataFrame, max_tracks: int | None = None) -> DataFrame:
    """Each track's first and last detection times; of the ``max_tracks`` tracks seen first, if given.

    Ties go by track id.  A NULL track id takes part in the ranking as one
    group, as in SQL, but never joins to points.
    """
    bounds = det.groupBy(TRACK).agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )
    if max_tracks is None:
        return bounds
    return bounds.orderBy(F.col("first_ts"), F.col(TRACK).asc_nulls_last()).limit(max_tracks)


def left_out(det: DataFrame, max_tracks: int | None) -> DataFrame:
    """One row: how many tracks a cap of ``max_tracks`` leaves out."""
    n = det.select(TRACK).distinct().agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("n") if max_tracks is None else F.lit(max_tracks)
    return n.select(F.greatest(F.col("n") - kept, F.lit(0)).cast("long").alias("tracks_left_out"))


def _with_keys(df: DataFrame, key: str, chunk: Column) -> DataFrame:
    """Window keys, none of them NULL: the key with NULL as '', whether it is NULL, and the chunk."""
    return df.select(
        "*",
        F.coalesce(F.col(key), F.lit("")).alias("_kk"),
        F.col(key).isNull().alias("_kn"),
        F.coalesce(chunk, F.lit(NO_TIME)).alias("_chunk"),
    )


def time_chunk(us: Column, key: str, chunk_ms: int) -> Column:
    """Number of the time chunk of an instant (microseconds); shorter chunks where ``key`` is NULL."""
    span = F.when(F.col(key).isNull(), F.lit(max(1, chunk_ms // NULL_CHUNKS))).otherwise(F.lit(chunk_ms)).cast("long")
    return F.floor(us / (span * F.lit(1000))).cast("long")


def _neighbours(
    keyed: DataFrame, values: list[str], back: bool, extra: dict[str, Column] | None = None
) -> DataFrame:
    """``keyed`` (with ``_kk, _kn, _chunk``) plus ``prev_<v>`` or ``next_<v>``: the value of the row before or
    behind within the same key in time order, and ``extra``, per-track aggregates of the chunk rows.

    ``extra`` maps a name to an aggregate over the chunk aggregate's columns
    ``lo`` and ``hi`` (first and last time) and ``first`` (its first row).
    """
    keys = ["_kk", "_kn", "_chunk"]
    order = F.struct(*ORDER)
    row = F.struct(*values)
    chunks = keyed.groupBy(*keys).agg(
        (F.max_by(row, order) if back else F.min_by(row, order)).alias("_edge"),
        F.min("timestamp").alias("lo"),
        F.max("timestamp").alias("hi"),
        F.min_by(row, order).alias("first"),
    )
    track = Window.partitionBy("_kk", "_kn")
    by_chunk = track.orderBy("_chunk")
    carry = chunks.select(
        *keys,
        (F.lag if back else F.lead)("_edge").over(by_chunk).alias("_carry"),
        *[agg.over(track).alias(name) for name, agg in (extra or {}).items()],
    )
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    near, name = (F.lag, "prev") if back else (F.lead, "next")
    inner = keyed.select(
        "*",
        near(F.lit(1)).over(w).isNull().alias("_edge_row"),
        *[near(v).over(w).alias(f"_{v}") for v in values],
    )
    joined = inner.join(carry, keys)
    value = [
        F.when(F.col("_edge_row"), F.col("_carry").getField(v)).otherwise(F.col(f"_{v}")).alias(f"{name}_{v}")
        for v in values
    ]
    own = [c for c in keyed.columns if c not in keys]
    return joined.select(*own, *value, *(extra or {}))


def with_previous(df: DataFrame, chunk: Column, values: list[str], key: str = TRACK) -> DataFrame:
    """``df`` with ``prev_<v>``; ``chunk`` must not fall with time within a key."""
    return _neighbours(_with_keys(df, key, chunk), values, back=True)


def step_distance(det: DataFrame, chunk_ms: int = DEFAULT_CHUNK_MS) -> DataFrame:
    """Metres from each detection to the previous raw detection of its track.

    0 when there is no previous point or its longitude does not parse;
    NULL when a needed coordinate is missing.  Detections without a
    timestamp stand before the first one of their track.
    """
    us = epoch_us(F.col("timestamp"), is_ntz(det, "timestamp"))
    points = _with_keys(det.select(TRACK, *ORDER, "lon", "lat"), TRACK, time_chunk(us, TRACK, chunk_ms))
    p = _neighbours(points, ["lon", "lat"], back=True)
    dist = F.when(F.col("prev_lon").isNull(), F.lit(0.0)).otherwise(
        haversine_m(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat"))
    )
    return p.select("event_id", TRACK, "timestamp", round_half_up(dist, 3).alias("distance_m"))


def thinned_points(det: DataFrame, thin: ThinParams) -> DataFrame:
    """Raw rows that survive thinning, of all tracks or of the ``thin.max_tracks`` seen first.

    A row is kept when it is the first of its time bucket (``interval_ms``
    from the track's first detection; 0 = one bucket per millisecond) and
    lies at least ``min_distance_m`` from the previous *raw* point (or has
    none), or when it is at the track's last timestamp.

    The source is read twice: for the points, and for the chunk aggregate
    that gives the carried rows and each track's first and last time.
    """
    pts = det.where(F.col(TRACK).isNotNull())
    if thin.max_tracks is not None:
        chosen = first_tracks(det, thin.max_tracks).select(F.col(TRACK).alias("_chosen"))
        pts = pts.join(chosen, F.col(TRACK) == F.col("_chosen"), "left_semi")
    ntz = is_ntz(det, "timestamp")
    pts = pts.withColumn("us", epoch_us(F.col("timestamp"), ntz))
    keyed = _with_keys(pts, TRACK, time_chunk(F.col("us"), TRACK, thin.chunk_ms))
    p = _neighbours(
        keyed, ["lon", "lat", "us"], back=True, extra={"first_ts": F.min("lo"), "last_ts": F.max("hi")}
    )
    interval = int(thin.interval_ms)

    def bucket(us: str) -> Column:
        if interval <= 0:
            return F.floor(F.col(us) / F.lit(1000)).cast("long")
        off_ms = F.floor((F.col(us) - epoch_us(F.col("first_ts"), ntz)) / F.lit(1000))
        return F.floor(off_ms / F.lit(interval)).cast("long")

    first_in_bucket = F.col("prev_us").isNull() | (bucket("prev_us") != bucket("us"))
    dist = F.when(F.col("prev_lon").isNull(), F.lit(0.0)).otherwise(
        haversine_m(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat"))
    )
    md = float(thin.min_distance_m)
    keep = (
        first_in_bucket
        & (F.lit(md == 0) | (dist >= F.lit(md)) | F.col("prev_lon").isNull())
    ) | (F.col("timestamp") == F.col("last_ts"))
    return p.where(keep).drop("us", "prev_us")


def _nonzero_or_zero(c: Column, value: Column) -> Column:
    """``value if c else 0`` for a nullable double ``c``."""
    return F.when(c.isNull() | (c == 0), F.lit(0.0)).otherwise(value)


def map_tracks(det: DataFrame, thin: ThinParams) -> DataFrame:
    """Thinned track points as the map consumes them.

    Coordinates to 5 decimals and heading to 1 (half-even), speed in mph
    to 1 decimal; missing or zero values become 0; zones parsed with the
    loader rule; raw types mapped only when known.
    """
    t = thinned_points(det, thin)
    speed = round_half_up(to_mph(F.col("speed_ms")), 1)
    return t.select(
        "event_id",
        F.col(TRACK).alias("track_id"),
        type_partial(F.col("object_type")).alias("object_type"),
        F.col("device_identifier").alias("device_id"),
        _nonzero_or_zero(F.col("lon"), round_half_even(F.col("lon"), 5)).alias("longitude"),
        _nonzero_or_zero(F.col("lat"), round_half_even(F.col("lat"), 5)).alias("latitude"),
        "timestamp",
        _nonzero_or_zero(speed, speed).alias("speed"),
        _nonzero_or_zero(F.col("heading"), round_half_even(F.col("heading"), 1)).alias("heading"),
        zones_loader(F.col("zones_hit")).alias("zones_hit"),
    )


def map_time_bounds(det: DataFrame, thin: ThinParams) -> DataFrame:
    """Time origin, end and span (ms) of the map points, from the track list.

    Thinning always keeps a track's first raw point (nothing before it)
    and its last one, so the points' time range equals the range of the
    selected tracks' first/last detections: a one-row aggregate.
    """
    sel = first_tracks(det, thin.max_tracks).where(F.col(TRACK).isNotNull())
    ntz = is_ntz(det, "timestamp")
    return sel.agg(
        F.min(epoch_ms(F.col("first_ts"), ntz)).alias("time_min_ms"),
        F.max(epoch_ms(F.col("last_ts"), ntz)).alias("time_max_ms"),
    ).select(
        "time_min_ms", "time_max_ms", (F.col("time_max_ms") - F.col("time_min_ms")).alias("time_range_ms")
    )


def track_time_range(points: DataFrame) -> DataFrame:
    """Time origin, end and span (ms) of the map points."""
    ntz = is_ntz(points, "timestamp")
    ms = epoch_ms(F.col("timestamp"), ntz)
    return points.agg(F.min(ms).alias("time_min_ms"), F.max(ms).alias("time_max_ms")).select(
        "time_min_ms", "time_max_ms", (F.col("time_max_ms") - F.col("time_min_ms")).alias("time_range_ms")
    )


def trips(points: DataFrame, time_min_ms: Column | None = None) -> DataFrame:
    """One row per track: time-ordered coordinates, offsets (ms) and speeds.

    ``points`` are map-track points (already thinned, so one track's list
    is bounded by period / interval).  The class is the first point's.
    ``time_min_ms`` is the time origin, usually ``map_time_bounds``'s one
    number; without it the earliest of ``points`` is looked up.
    """
    ntz = is_ntz(points, "timestamp")
    us = epoch_us(F.col("timestamp"), ntz)
    point = F.struct(
        us.alias("us"), F.col("event_id").alias("eid"), F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"), F.coalesce(F.col("speed"), F.lit(0.0)).alias("speed"),
    )
    g = points.groupBy("track_id").agg(
        F.array_sort(F.collect_list(point)).alias("pts"),
        F.min_by(F.struct("object_type"), F.struct(us, "event_id")).alias("first"),
    )
    return g.withColumn("_t0", _origin(points, time_min_ms)).select(
        F.col("track_id").alias("trackId"),
        F.col("first.object_type").alias("objectType"),
        F.transform("pts", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"),
        F.transform("pts", lambda x: F.floor(x["us"] / 1000).cast("long") - F.col("_t0")).alias("timestamps"),
        F.transform("pts", lambda x: x["speed"]).alias("speeds"),
    )


def _origin(points: DataFrame, time_min_ms: Column | None) -> Column:
    if time_min_ms is not None:
        return time_min_ms
    return points.select(F.min(epoch_ms(F.col("timestamp"), is_ntz(points, "timestamp")))).scalar()


def _segments(points: DataFrame, time_min_ms: Column | None, chunk_ms: int = DEFAULT_CHUNK_MS) -> DataFrame:
    """Each point with the next one of its track, times as offsets from the origin."""
    ntz = is_ntz(points, "timestamp")
    p = points.select(
        "track_id", "object_type", "timestamp", "event_id", "longitude", "latitude",
        F.coalesce(F.col("speed"), F.lit(0.0)).alias("speed"),
        epoch_ms(F.col("timestamp"), ntz).alias("ms"),
    )
    keyed = _with_keys(p, "track_id", time_chunk(epoch_us(F.col("timestamp"), ntz), "track_id", chunk_ms))
    values = ["ms", "longitude", "latitude", "speed", "object_type"]
    near = _neighbours(keyed, values, back=False, extra={"opening": F.min_by("first", "lo")})
    t0 = _origin(points, time_min_ms)
    return near.select(
        "track_id",
        F.col("opening.object_type").alias("objectType"),
        (F.col("ms") - t0).alias("t"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
        "speed",
        (F.col("next_ms") - t0).alias("nt"),
        F.col("next_longitude").alias("nlon"),
        F.col("next_latitude").alias("nlat"),
        F.coalesce("next_speed", F.lit(0.0)).alias("nspeed"),
    )


def _between(at: Column) -> list[Column]:
    """``lon, lat, speed`` at ``at`` on a segment: its first point, or moved towards the next one."""
    exact = F.col("nt").isNull() | (at == F.col("t"))
    frac = F.try_divide((at - F.col("t")).cast("double"), (F.col("nt") - F.col("t")).cast("double"))
    return [
        F.when(exact, F.col(c)).otherwise(F.col(c) + (F.col(f"n{c}") - F.col(c)) * frac).alias(c)
        for c in ("lon", "lat", "speed")
    ]


def trip_heads(
    points: DataFrame, step_ms: int = PLAYBACK_STEP_MS, time_min_ms: Column | None = None
) -> DataFrame:
    """Interpolated head position of every trip at playback frames.

    Frames are offsets 0, step, 2*step, ... from the time origin.  At a
    frame T a trip shows the last point at or before T, moved linearly
    toward the next point; exactly at a point (or at the end) the point
    itself.  Trips not yet started or already ended show nothing.  Each
    segment [t_i, t_i+1) expands to its own frames, so no join is needed.
    """
    s = _segments(points, time_min_ms)
    step = F.lit(int(step_ms))
    lo = F.ceil(F.col("t") / step).cast("long") * step
    hi = F.when(F.col("nt").isNull(), F.col("t")).otherwise(F.col("nt") - 1)
    frames = s.where(lo <= hi).select(
        "*", F.explode(F.sequence(lo, hi, step)).alias("frame_ms")
    )
    return frames.select("frame_ms", F.col("track_id").alias("trackId"), "objectType", *_between(F.col("frame_ms")))


def heads_at(points: DataFrame, at_ms: int, time_min_ms: Column | None = None) -> DataFrame:
    """Head positions at one instant, ``at_ms`` from the time origin: what the map draws for a playback time.

    One aggregate per track: its last point at or before the instant and
    its first one behind it.
    """
    ntz = is_ntz(points, "timestamp")
    t0 = _origin(points, time_min_ms)
    p = points.select(
        "track_id", "object_type", (epoch_ms(F.col("timestamp"), ntz) - t0).alias("t"), F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"), F.coalesce(F.col("speed"), F.lit(0.0)).alias("speed"),
        F.struct("timestamp", "event_id").alias("o"),
    )
    here, point = F.col("t") <= at_ms, F.struct("t", "lon", "lat", "speed")
    g = p.groupBy("track_id").agg(
        F.min_by(F.struct("object_type"), "o").alias("opening"),
        F.max_by(F.when(here, point), F.when(here, F.col("o"))).alias("a"),
        F.min_by(F.when(~here, point), F.when(~here, F.col("o"))).alias("b"),
    )
    live = g.where(F.col("a").isNotNull() & (F.col("b").isNotNull() | (F.col("a.t") == at_ms)))
    seg = live.select(
        "track_id", "opening", "a.*", F.col("b.t").alias("nt"), F.col("b.lon").alias("nlon"),
        F.col("b.lat").alias("nlat"), F.col("b.speed").alias("nspeed"),
    )
    return seg.select(
        F.col("track_id").alias("trackId"), F.col("opening.object_type").alias("objectType"), *_between(F.lit(at_ms))
    )


def trail_at(
    points: DataFrame, at_ms: int, trail_ms: int = TRAIL_LENGTH_MS, time_min_ms: Column | None = None
) -> DataFrame:
    """Points of the fading trail at one instant: ``at_ms - trail_ms <= t <= at_ms``."""
    t = epoch_ms(F.col("timestamp"), is_ntz(points, "timestamp")) - _origin(points, time_min_ms)
    p = points.select(
        F.col("track_id").alias("trackId"), t.alias("t"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat")
    )
    return p.where(F.col("t").between(at_ms - trail_ms, at_ms))


def trip_trail(
    points: DataFrame,
    step_ms: int = PLAYBACK_STEP_MS,
    trail_ms: int = TRAIL_LENGTH_MS,
    time_min_ms: Column | None = None,
    time_range_ms: Column | None = None,
) -> DataFrame:
    """Points drawn as the fading trail at each frame: T - trail <= t <= T.

    Frames run from 0 to the time range (the playback scrubber's span).
    Every point comes once per frame that shows it, in the order of time; for
    one frame use :func:`trail_at`.
    """
    ms = epoch_ms(F.col("timestamp"), is_ntz(points, "timestamp"))
    t0 = _origin(points, time_min_ms)
    t = ms - t0
    t_max = time_range_ms if time_range_ms is not None else points.select(F.max(ms)).scalar() - t0
    step = F.lit(int(step_ms))
    lo = F.ceil(t / step).cast("long") * step
    hi = F.floor(F.least(t + F.lit(int(trail_ms)), t_max) / step).cast("long") * step
    return points.where(lo <= hi).orderBy(ms, "track_id").select(
        F.explode(F.sequence(lo, hi, step)).alias("frame_ms"),
        F.col("track_id").alias("trackId"),
        t.alias("t"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
    )
