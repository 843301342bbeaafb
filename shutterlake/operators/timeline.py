"""Events on a timeline: segmentation by time and place, summaries, locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from shutterlake.functions import media as M
from shutterlake.operators.dedup import first_per_group
from shutterlake.operators.ordering import SLICE, attach, sorted_slices
from shutterlake.operators.skew import skew_join
from shutterlake.session import materialize

EVENT_GAP_SECONDS = 2 * 3600
EVENT_GAP_KM = 1.0
MAP_DEFAULT_CENTER = (40.0, -74.0)
MARKER_MAX_RADIUS = 20


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def far_apart(a: Column, b: Column, km: float) -> Column:
    """Both positions known and further apart than km."""
    d = M.haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])
    return F.coalesce((a.isNotNull() & b.isNotNull()) & (d > km), F.lit(False))


def _slices(df: DataFrame, ts: str, key: str, owner: str | None) -> tuple[DataFrame, str]:
    """Dated rows in sorted slices, and the owner column (a constant for one timeline)."""
    base = df.where(F.col(ts).isNotNull())
    own = owner or "_owner"
    if owner is None:
        base = base.withColumn(own, F.lit(0))
    return sorted_slices(base, [own, ts, key]), own


def _carry(cut: DataFrame, own: str, ts: str, gps: str, key: str) -> tuple[DataFrame, WindowSpec]:
    """Add the last time and place before each slice, for the owner it continues.

    What a slice hands on is the end of its last owner, and what it needs is the
    state of its first owner: one row per slice each.
    """
    order = F.struct(ts, key)
    ends = cut.groupBy(SLICE, own).agg(
        F.max(ts).alias("_end"),
        F.max_by(gps, F.when(F.col(gps).isNotNull(), order)).alias("_gps"),
    )
    before = W.partitionBy(own).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        ends.withColumn("_prev_end", F.last("_end").over(before))
        .withColumn("_prev_gps", F.last("_gps", ignorenulls=True).over(before))
        .where(F.col("_prev_end").isNotNull())
        .select(SLICE, own, "_prev_end", "_prev_gps")
    )
    return attach(cut, carry, [SLICE, own]), before


def _last_gps(in_slice: WindowSpec, gps: str) -> Column:
    earlier = in_slice.rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.last(gps, ignorenulls=True).over(earlier), F.col("_prev_gps"))


def last_known_location(
    df: DataFrame,
    ts: str = "ts",
    gps: str = "gps",
    key: str = "media_id",
    partition_by: str | None = None,
) -> DataFrame:
    """Add `last_gps`, the latest known position before each dated row."""
    cut, own = _slices(df, ts, key, partition_by)
    joined, _ = _carry(cut, own, ts, gps, key)
    in_slice = W.partitionBy(SLICE, own).orderBy(ts, key)
    return joined.withColumn("last_gps", _last_gps(in_slice, gps)).select(*df.columns, "last_gps")


def segment_events(
    df: DataFrame,
    ts: str = "ts",
    gps: str = "gps",
    key: str = "media_id",
    gap_seconds: float = EVENT_GAP_SECONDS,
    km: float = EVENT_GAP_KM,
    partition_by: str | None = None,
) -> DataFrame:
    """Cut the timeline where the time gap or the move from the last known place is too big.

    Works for one global timeline and for owners of any size. Rows are cut into
    sorted slices; each slice needs only the last time, the last known position
    and the number of events before it, and those are tables of at most two rows
    per slice.
    """
    cut, own = _slices(df, ts, key, partition_by)
    in_slice = W.partitionBy(SLICE, own).orderBy(ts, key)
    joined, before = _carry(cut, own, ts, gps, key)
    last_ts = F.coalesce(F.lag(ts).over(in_slice), F.col("_prev_end"))
    last_gps = _last_gps(in_slice, gps)
    gap = micros(F.col(ts)) - micros(last_ts)
    is_cut = (gap > F.lit(int(gap_seconds * 1_000_000))) | far_apart(last_gps, F.col(gps), km)
    flagged = joined.withColumn("_cut", F.coalesce(is_cut, F.lit(False)).cast("long")).drop(
        "_prev_end", "_prev_gps"
    )
    starts = (
        flagged.groupBy(SLICE, own)
        .agg(F.sum("_cut").alias("_cuts"))
        .withColumn("_before", F.sum("_cuts").over(before))
        .where(F.col("_before").isNotNull())
        .drop("_cuts")
    )
    numbered = attach(
        flagged.withColumn("_local", F.sum("_cut").over(in_slice)), starts, [SLICE, own]
    )
    event = F.col("_local") + F.coalesce("_before", F.lit(0))
    return numbered.select(*df.columns, event.alias("event_id"))


def event_summary(
    events: DataFrame,
    by: Sequence[str] = ("event_id",),
    key: str = "media_id",
    location: str = "location_name",
    sample: int = 5,
) -> DataFrame:
    """Span, first known place and position, size and first photos of every event."""
    order = F.struct("ts", key)
    span = events.groupBy(*by).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.coalesce(
            F.min_by(location, F.when(F.col(location).isNotNull(), order)), F.lit("Unknown")
        ).alias("location"),
        F.min_by("gps", F.when(F.col("gps").isNotNull(), order)).alias("gps_center"),
        F.count("*").alias("num_photos"),
    )
    firsts = first_per_group(
        events.select(*by, "ts", key), by, [F.col("ts").asc(), F.col(key).asc()], sample
    )
    samples = firsts.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda s: s[key]).alias("sample_photos")
    )
    return span.join(samples, list(by))


def similar_summary(groups: DataFrame, by: str = "group_id", key: str = "media_id") -> DataFrame:
    """Members and earliest date per group, one row per member, leader first.

    Members stay rows instead of one list per group, since a burst has no size limit.
    """
    groups = materialize(groups.select(by, key, "ts"))
    sizes = groups.groupBy(by).agg(
        F.count("*").alias("photo_count"), F.min("ts").alias("earliest")
    )
    return skew_join(groups.select(by, key), sizes, [by])


def map_markers(events: DataFrame, key: str = "media_id") -> DataFrame:
    """Marker per event with a position; radius grows with the photo count up to 20."""
    s = event_summary(events, key=key).where(F.col("gps_center").isNotNull())
    return s.select(
        "event_id",
        F.col("gps_center.lat").alias("lat"),
        F.col("gps_center.lon").alias("lon"),
        F.least(F.col("num_photos"), F.lit(MARKER_MAX_RADIUS)).alias("radius"),
        F.date_format("first_ts", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"),
        "num_photos",
    )


def map_center(events: DataFrame, key: str = "media_id") -> DataFrame:
    """First position on the timeline, else the default centre."""
    order = F.struct("event_id", "ts", key)
    first = F.min_by("gps", F.when(F.col("gps").isNotNull(), order))
    lat, lon = MAP_DEFAULT_CENTER
    return events.agg(first.alias("_g")).select(
        F.coalesce("_g.lat", F.lit(lat)).alias("lat"), F.coalesce("_g.lon", F.lit(lon)).alias("lon")
    )


def attach_location(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Address of the rounded position. The cache side is left to the optimizer to size."""
    key = M.location_key(F.col("gps.lat"), F.col("gps.lon"))
    found = cache.select(F.col("key").alias("_key"), F.col("address").alias("location_name"))
    return df.withColumn("_key", key).join(found, "_key", "left").drop("_key")


def coordinates_to_resolve(df: DataFrame, cache: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct rounded positions the cache does not know; a run may cap them, the first by key."""
    keys = (
        df.where(F.col("gps").isNotNull())
        .select(M.location_key(F.col("gps.lat"), F.col("gps.lon")).alias("key"))
        .distinct()
    )
    keys = keys.join(cache.select("key"), "key", "left_anti")
    return keys if limit is None else keys.orderBy("key").limit(limit)
