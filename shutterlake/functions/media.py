"""Metadata expressions: quality, distance, hashes, tags, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake import schemas
from shutterlake.functions.paths import MB

EARTH_KM = 6371.0

# EXIF date tags in order, and their one format.
EXIF_DATE_TAGS = ("DateTimeOriginal", "DateTime", "DateTimeDigitized")
EXIF_DATE_FORMAT = "yyyy:MM:dd HH:mm:ss"

# Container tags that may hold a creation time, with accepted formats.
VIDEO_TIME_TAGS = (
    "creation_time", "date", "creation_date",
    "com.apple.quicktime.creationdate", "com.android.capture.time",
)
VIDEO_TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyyMMdd",
    EXIF_DATE_FORMAT,
)

# Tags that may hold a position.
ISO6709_TAG = "location"
ISO6709 = r"^([+-]\d+\.?\d*)([+-]\d+\.?\d*)"
LAT_TAGS = ("location-latitude", "com.apple.quicktime.location.latitude", "GPS:Latitude")
LON_TAGS = ("location-longitude", "com.apple.quicktime.location.longitude", "GPS:Longitude")

WARNINGS = (
    "Image size could not be read",
    "Perceptual hash not generated",
    "SHA-256 hash not generated",
)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def quality_score(pixels: Column, size_bytes: Column) -> Column:
    return F.coalesce(pixels.cast("long") * 1000 + size_bytes.cast("long"), F.lit(0).cast("long"))


def gps(lat: Column, lon: Column) -> Column:
    """Position struct, null unless both coordinates are there."""
    return F.when(
        lat.isNotNull() & lon.isNotNull(),
        F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")),
    )


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def valid_gps(lat: Column, lon: Column) -> Column:
    return in_range(lat, lon) & ~((lat == 0) & (lon == 0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    # `least` would skip a null distance and return its bound.
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def average_hash64(pixels: Column) -> Column:
    """One bit per grey value that reaches the mean, first value in the top bit."""
    total = F.aggregate(pixels, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    mean = total / F.size(pixels)
    return F.aggregate(
        pixels,
        F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(
            F.when(x.cast("double") >= mean, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ),
    )


def _first_time(value: Column, formats: tuple[str, ...]) -> list[Column]:
    return [F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in formats]


def exif_datetime(tags: Column, mtime: Column) -> Column:
    """First date tag that parses, else the modification time."""
    parsed = [t for name in EXIF_DATE_TAGS for t in _first_time(tags[name], (EXIF_DATE_FORMAT,))]
    return F.coalesce(*parsed, mtime.cast("timestamp_ntz"))


def video_creation_time(tags: Column) -> Column:
    return F.coalesce(*[t for n in VIDEO_TIME_TAGS for t in _first_time(tags[n], VIDEO_TIME_FORMATS)])


def video_gps(tags: Column) -> Column:
    """ISO 6709 text when it is in range, else paired latitude/longitude tags."""
    text = tags[ISO6709_TAG]
    lat = F.regexp_extract(text, ISO6709, 1).try_cast("double")
    lon = F.regexp_extract(text, ISO6709, 2).try_cast("double")
    tag_lat = F.coalesce(*[tags[n].try_cast("double") for n in LAT_TAGS])
    tag_lon = F.coalesce(*[tags[n].try_cast("double") for n in LON_TAGS])
    return F.when(in_range(lat, lon), gps(lat, lon)).when(
        in_range(tag_lat, tag_lon), gps(tag_lat, tag_lon)
    )


def frame_rate(text: Column) -> Column:
    parts = F.split(text, "/")
    ratio = F.try_divide(
        F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    )
    return F.when(F.size(parts) == 2, ratio).when(F.size(parts) == 1, text.try_cast("double"))


def first_video_stream(streams: Column) -> Column:
    return F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))


def _rational(v: Column) -> Column:
    return F.coalesce(F.try_divide(v["num"].cast("double"), v["den"].cast("double")), F.lit(0.0))


def dms_to_degrees(parts: Column, ref: Column, negative: str) -> Column:
    """Degrees, minutes, seconds as rationals; fewer than three parts count as 0."""
    value = (
        _rational(F.get(parts, F.lit(0)))
        + _rational(F.get(parts, F.lit(1))) / 60
        + _rational(F.get(parts, F.lit(2))) / 3600
    )
    value = F.when(F.size(parts) >= 3, value).otherwise(F.lit(0.0))
    return F.when(ref == negative, -value).otherwise(value)


def exif_gps(tag: Column) -> Column:
    lat = dms_to_degrees(tag["lat"], tag["lat_ref"], "S")
    lon = dms_to_degrees(tag["lon"], tag["lon_ref"], "W")
    return F.when(tag.isNotNull() & valid_gps(lat, lon), gps(lat, lon))


def megapixels(pixels: Column) -> Column:
    return F.round(pixels / 1e6, 2)


def size_mb(size_bytes: Column) -> Column:
    return F.round(size_bytes / F.lit(MB), 2)


def resolution_text(width: Column, height: Column) -> Column:
    return F.format_string("%dx%d", width, height)


def resolution_or_proxy(pixels: Column, size_bytes: Column, video: Column) -> Column:
    """Pixels for images; videos use their byte count."""
    return F.when(video, size_bytes).otherwise(pixels)


def viewer_resolution(pixels: Column, size_bytes: Column, video: Column) -> Column:
    """The review screen scales megabytes by a million instead."""
    return F.when(video, (size_bytes / F.lit(MB) * 1000000).cast("long")).otherwise(pixels)


def extraction_warnings(resolution: Column, phash: Column, sha256: Column) -> Column:
    return F.nullif(
        F.concat_ws(
            ", ",
            F.when(F.coalesce(resolution, F.lit(0)) == 0, WARNINGS[0]),
            F.when(phash.isNull(), WARNINGS[1]),
            F.when(sha256.isNull() | (sha256 == ""), WARNINGS[2]),
        ),
        F.lit(""),
    )


def box_from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    x, y = x1.cast("int"), y1.cast("int")
    return F.struct(
        x.alias("x"),
        y.alias("y"),
        (x2.cast("int") - x).alias("w"),
        (y2.cast("int") - y).alias("h"),
    )


def is_empty_box(box: Column) -> Column:
    return (box["w"] <= 0) | (box["h"] <= 0)


def box_from_json(text: Column) -> Column:
    """Accepts x/left, y/top, w/width and h/height; a missing side is 0."""
    raw = F.from_json(text, schemas.BOX)
    zero = F.lit(0)
    return F.struct(
        F.coalesce(raw["x"], raw["left"], zero).alias("x"),
        F.coalesce(raw["y"], raw["top"], zero).alias("y"),
        F.coalesce(raw["w"], raw["width"], zero).alias("w"),
        F.coalesce(raw["h"], raw["height"], zero).alias("h"),
    )


def display_name(name: Column, cluster_id: Column, prefix: str = "Person ") -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit(prefix), cluster_id.cast("string")))


def confidence_band(similarity: Column) -> Column:
    return (
        F.when(similarity > 0.85, "high_confidence")
        .when(similarity >= 0.75, "moderate")
        .when(similarity >= 0.65, "low")
        .otherwise("none")
    )


def round_coordinate(value: Column) -> Column:
    """Three decimals in shortest form: 40.0, not 40.000."""
    return F.bround(value, 3).cast("string")


def location_key(lat: Column, lon: Column) -> Column:
    return F.concat(round_coordinate(lat), F.lit(","), round_coordinate(lon))
