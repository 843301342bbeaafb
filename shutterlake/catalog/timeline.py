"""Queries over timelines, places and tag tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake import schemas
from shutterlake.catalog.core import hashes, media, place_cache, query, table, timeline
from shutterlake.catalog.files import scratch
from shutterlake.functions import media as M
from shutterlake.functions import vectors as V
from shutterlake.operators import bursts as B
from shutterlake.operators import timeline as T
from shutterlake.sources import reports as O
from shutterlake.sources import tags as G

HAVERSINE = """2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2)
  + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))))"""


def segmented(partition: str) -> str:
    """SQL for events; the partition clause is empty for one global timeline."""
    return f"""
      SELECT *, sum(cut) OVER ({partition} ORDER BY ts, media_id)::BIGINT AS event_id FROM (
        SELECT *, CASE WHEN ts - pts > INTERVAL 2 HOURS OR (lat IS NOT NULL AND plat IS NOT NULL AND {HAVERSINE} > 1.0) THEN 1 ELSE 0 END AS cut FROM (
          SELECT *, lag(ts) OVER ({partition} ORDER BY ts, media_id) AS pts,
            last_value(lat IGNORE NULLS) OVER ({partition} ORDER BY ts, media_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plat,
            last_value(lon IGNORE NULLS) OVER ({partition} ORDER BY ts, media_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plon
          FROM {{timeline}}))"""


GLOBAL_EVENTS = segmented("")
OWNER_EVENTS = segmented("PARTITION BY owner")


@query("i8_segment_events", f"SELECT media_id, event_id FROM ({GLOBAL_EVENTS})")
def i8(spark, d):
    return T.segment_events(timeline(spark, d)).select("media_id", "event_id")


@query("i8_segment_events_per_owner", f"SELECT media_id, owner, event_id FROM ({OWNER_EVENTS})")
def i8_owner(spark, d):
    return T.segment_events(timeline(spark, d), partition_by="owner").select(
        "media_id", "owner", "event_id"
    )


@query(
    "e3_segment_events_time_only",
    """SELECT media_id, owner, sum(c) OVER (PARTITION BY owner ORDER BY ts, media_id)::BIGINT AS event_id FROM (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY owner ORDER BY ts, media_id) > INTERVAL 2 HOURS THEN 1 ELSE 0 END AS c FROM {timeline})""",
)
def e3(spark, d):
    unplaced = F.lit(None).cast("struct<lat:double,lon:double>")
    rows = timeline(spark, d).withColumn("gps", unplaced)
    return T.segment_events(rows, partition_by="owner").select("media_id", "owner", "event_id")


@query(
    "e4_last_known_location",
    """SELECT media_id, coalesce(last_value(lat IGNORE NULLS) OVER w, -1)::DOUBLE AS last_lat FROM {timeline}
       WINDOW w AS (PARTITION BY owner ORDER BY ts, media_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def e4(spark, d):
    rows = T.last_known_location(timeline(spark, d), partition_by="owner")
    return rows.select("media_id", F.coalesce("last_gps.lat", F.lit(-1.0)).alias("last_lat"))


SUMMARY = f"""
  SELECT event_id, min(ts) AS first_ts, max(ts) AS last_ts,
    coalesce(arg_min(location_name, (ts, media_id)) FILTER (location_name IS NOT NULL), 'Unknown') AS location,
    coalesce(arg_min(lat, (ts, media_id)) FILTER (lat IS NOT NULL), -1) AS lat,
    coalesce(arg_min(lon, (ts, media_id)) FILTER (lat IS NOT NULL), -1) AS lon,
    count(*) AS num_photos, array_to_string(list(media_id ORDER BY ts, media_id)[1:5], '|') AS sample_photos
  FROM ({GLOBAL_EVENTS}) GROUP BY event_id"""


def flat(summary: DataFrame) -> DataFrame:
    return summary.select(
        "event_id",
        "first_ts",
        "last_ts",
        "location",
        F.coalesce("gps_center.lat", F.lit(-1.0)).alias("lat"),
        F.coalesce("gps_center.lon", F.lit(-1.0)).alias("lon"),
        "num_photos",
        F.array_join(F.col("sample_photos").cast("array<string>"), "|").alias("sample_photos"),
    )


@query("d11_event_summary", SUMMARY)
def d11(spark, d):
    return flat(T.event_summary(T.segment_events(timeline(spark, d))))


@query("a10_event_report", SUMMARY)
def a10(spark, d):
    """The event summary written as JSON with its nested columns and read back."""
    out = scratch(spark)
    O.write_report(T.event_summary(T.segment_events(timeline(spark, d))), out)
    ddl = (
        "event_id BIGINT, first_ts TIMESTAMP_NTZ, last_ts TIMESTAMP_NTZ, location STRING, "
        "gps_center STRUCT<lat:DOUBLE,lon:DOUBLE>, num_photos BIGINT, sample_photos ARRAY<BIGINT>"
    )
    return flat(O.read_report(spark, out, ddl))


@query(
    "d13_map_markers",
    f"""SELECT event_id, lat, lon, least(num_photos, 20)::BIGINT AS radius, strftime(first_ts, '%Y-%m-%d') AS first_day,
          strftime(last_ts, '%Y-%m-%d') AS last_day, num_photos FROM ({SUMMARY}) WHERE lat <> -1""",
)
def d13(spark, d):
    return T.map_markers(T.segment_events(timeline(spark, d)))


@query(
    "d13_map_center",
    "SELECT arg_min(lat, (ts, media_id)) AS lat, arg_min(lon, (ts, media_id)) AS lon FROM {timeline} WHERE lat IS NOT NULL",
)
def d13_center(spark, d):
    return T.map_center(T.segment_events(timeline(spark, d)))


@query(
    "h3_haversine",
    f"""SELECT a.media_id, round({HAVERSINE}, 6) AS km FROM {{timeline}} a,
          (SELECT 40.0::DOUBLE AS plat, -74.0::DOUBLE AS plon) WHERE lat IS NOT NULL""",
)
def h3(spark, d):
    km = M.haversine_km(F.lit(40.0), F.lit(-74.0), F.col("lat"), F.col("lon"))
    return timeline(spark, d).where(F.col("lat").isNotNull()).select(
        "media_id", F.round(km, 6).alias("km")
    )


@query(
    "b16_valid_gps",
    """SELECT event_id, (value - 50 BETWEEN -90 AND 90) AND (k * 5 - 200 BETWEEN -180 AND 180)
         AND NOT (value - 50 = 0 AND k * 5 - 200 = 0) AS ok
       FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)""",
)
def b16(spark, d):
    return timeline(spark, d).select(
        F.col("media_id").alias("event_id"),
        M.valid_gps(F.col("value") - 50, F.col("k") * 5 - 200).alias("ok"),
    )


KEYED = """SELECT media_id, CASE WHEN lat IS NULL THEN '' ELSE round(lat, 3)::VARCHAR || ',' || round(lon, 3)::VARCHAR END AS key FROM {timeline}"""


@query(
    "c6_attach_location",
    f"SELECT t.media_id, c.address AS location_name FROM ({KEYED}) t LEFT JOIN {{place_cache}} c ON c.key = t.key",
)
def c6(spark, d):
    rows = timeline(spark, d).drop("location_name")
    return T.attach_location(rows, place_cache(spark, d)).select("media_id", "location_name")


@query(
    "d31_coordinates_to_resolve",
    f"""SELECT DISTINCT key FROM ({KEYED}) WHERE key <> '' AND key NOT IN (SELECT key FROM {{place_cache}})
        """,
)
def d31(spark, d):
    return T.coordinates_to_resolve(timeline(spark, d), place_cache(spark, d))


@query(
    "a11_geocode_cache_entries",
    "SELECT key, address, count(*) AS n FROM (SELECT 'k' AS key, regexp_extract(props, '[0-9]+') AS address FROM events) GROUP BY key, address",
)
def a11(spark, d):
    """JSON maps in text become (key, address) rows."""
    entries = O.cache_entries(table(spark, d, "events"), "props")
    return entries.groupBy("key", "address").agg(F.count("*").alias("n"))


@query(
    "c18_burst_links",
    """SELECT first, second, round(gap, 6) AS gap_s FROM (
         SELECT media_id AS first, lead(media_id) OVER w AS second,
           epoch_us(lead(ts) OVER w) / 1e6 - epoch_us(ts) / 1e6 AS gap,
           epoch_us(lead(ts) OVER w) - epoch_us(ts) AS us
         FROM {timeline} WINDOW w AS (ORDER BY ts, media_id)) WHERE us <= 60000000""",
)
def c18(spark, d):
    links = B.candidate_pairs(timeline(spark, d), window_s=60)
    return links.withColumn("gap_s", F.round("gap_s", 6))


@query(
    "c18_window_pairs",
    """SELECT a.media_id AS first, b.media_id AS second, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 6) AS gap_s
       FROM {timeline} a JOIN {timeline} b ON epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 300000000
        AND (a.ts < b.ts OR a.media_id < b.media_id)""",
)
def c18_window(spark, d):
    pairs = B.window_pairs(timeline(spark, d), window_s=300)
    return pairs.withColumn("gap_s", F.round("gap_s", 6))


def burst_input(spark: SparkSession, d: str) -> DataFrame:
    """Timeline events (dated) and documents (undated, hashed by their words) as one library."""
    shots = timeline(spark, d).select(
        F.col("media_id"), "ts", "gps", F.xxhash64("media_id").alias("phash")
    )
    docs = media(spark, d).join(hashes(spark, d), "media_id").select(
        (-F.col("media_id") - 1).alias("media_id"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
        "gps",
        "phash",
    )
    return shots.unionByName(docs)


@query("i9_group_similar")
def i9(spark, d):
    return B.group_similar(burst_input(spark, d), window_s=30).select("group_id", "media_id")


@query("d12_similar_summary")
def d12(spark, d):
    return T.similar_summary(B.group_similar(burst_input(spark, d), window_s=30))


@query(
    "i9_time_only_bursts",
    """WITH RECURSIVE o AS (SELECT media_id, epoch_us(ts) AS t FROM {timeline}),
         first AS (SELECT arg_min(media_id, (t, media_id)) AS leader, min(t) AS t FROM o),
         chain AS (SELECT leader, t FROM first
           UNION ALL
           SELECT n.media_id, n.t FROM chain c, LATERAL (
             SELECT media_id, t FROM o WHERE o.t > c.t + 600000000 ORDER BY t, media_id LIMIT 1) n),
         m AS (SELECT c.leader AS group_id, o.media_id FROM o ASOF JOIN chain c ON o.t >= c.t)
       SELECT group_id, media_id FROM m WHERE group_id IN (SELECT group_id FROM m GROUP BY 1 HAVING count(*) > 1)""",
)
def i9_time(spark, d):
    """Bursts without places: the leader rule by time alone, with a wide window."""
    shots = timeline(spark, d).select(
        "media_id", "ts", F.lit(None).cast("struct<lat:double,lon:double>").alias("gps"),
        F.lit(0).cast("long").alias("phash"),
    )
    return B.group_similar(shots, window_s=600).select("group_id", "media_id")


# ---- tags -------------------------------------------------------------------------


@query(
    "h8_exif_datetime",
    """SELECT media_id, CASE WHEN value < 20 THEN date_trunc('second', ts)
         WHEN value < 60 THEN date_trunc('second', ts + INTERVAL 1 DAY) ELSE ts END AS ts FROM {timeline}""",
)
def h8(spark, d):
    fmt = "yyyy:MM:dd HH:mm:ss"
    v = F.col("value")
    tags = F.map_from_arrays(
        F.array(F.lit("DateTimeOriginal"), F.lit("DateTime")),
        F.array(
            F.when(v < 20, F.date_format("ts", fmt)).otherwise(F.lit("0000:00:00 00:00:00")),
            F.when(v < 60, F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), fmt)).otherwise(
                F.lit("not a date")
            ),
        ),
    )
    return timeline(spark, d).select("media_id", M.exif_datetime(tags, F.col("ts")).alias("ts"))


@query(
    "h9_video_creation_time",
    """SELECT media_id, CASE k % 7 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('second', ts)
         WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('day', ts)
         WHEN 5 THEN date_trunc('second', ts) END AS ts FROM {timeline}""",
)
def h9(spark, d):
    k, ts = F.col("k") % 7, F.col("ts")
    value = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(k == 4, F.date_format(ts, "yyyyMMdd"))
        .when(k == 5, F.date_format(ts, "yyyy:MM:dd HH:mm:ss"))
        .otherwise("yesterday")
    )
    tag = F.when(F.col("value") < 30, "creation_time").otherwise("com.android.capture.time")
    tags = F.create_map(tag, value)
    return timeline(spark, d).select("media_id", M.video_creation_time(tags).alias("ts"))


@query(
    "h10_video_gps",
    """SELECT media_id, CASE k % 4 WHEN 0 THEN lat WHEN 1 THEN lat WHEN 2 THEN NULL ELSE NULL END AS lat,
         CASE k % 4 WHEN 0 THEN lon WHEN 1 THEN lon END AS lon
       FROM (SELECT media_id, k, 40 + k * 0.25::DOUBLE AS lat, -74 - k * 0.5::DOUBLE AS lon FROM {timeline})""",
)
def h10(spark, d):
    k = F.col("k")
    lat, lon = 40 + k * F.lit(0.25), -74 - k * F.lit(0.5)
    text = F.concat(F.format_string("%+.2f", lat), F.format_string("%+.2f", lon), F.lit("/"))
    tags = F.map_from_arrays(
        F.array(F.lit("location"), F.lit("location-latitude"), F.lit("GPS:Longitude")),
        F.array(
            F.when(k % 4 == 0, text).when(k % 4 == 2, F.lit("+95.0+10.0/")),
            F.when(k % 4 == 1, lat.cast("string")).otherwise(F.lit("north")),
            F.when(k % 4 != 2, lon.cast("string")),
        ),
    )
    found = M.video_gps(tags)
    return timeline(spark, d).select("media_id", found["lat"].alias("lat"), found["lon"].alias("lon"))


@query(
    "h11_frame_rate",
    """SELECT media_id, CASE k % 3 WHEN 0 THEN round(30000.0::DOUBLE / (k + 1), 6) WHEN 1 THEN NULL ELSE value END AS fps FROM {timeline}""",
)
def h11(spark, d):
    k = F.col("k")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("30000/"), k + 1))
        .when(k % 3 == 1, F.lit("25/0"))
        .otherwise(F.col("value").cast("string"))
    )
    return timeline(spark, d).select("media_id", F.round(M.frame_rate(text), 6).alias("fps"))


@query(
    "a14_h12_video_probe",
    """SELECT media_id, value AS duration, k::BIGINT * 1000 AS bitrate, date_trunc('second', ts) AS creation_time,
         lat, lon, k + 100 AS width, k + 50 AS height, (k + 100)::BIGINT * (k + 50) AS resolution, 'h264' AS codec,
         25.0::DOUBLE AS fps FROM {timeline}""",
)
def a14(spark, d):
    """Container and stream JSON to typed columns; the second video stream is ignored."""
    k, ts = F.col("k"), F.col("ts")
    moment = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    place = F.when(
        F.col("lat").isNotNull(),
        F.create_map(F.lit("GPS:Latitude"), F.col("lat").cast("string"),
                     F.lit("GPS:Longitude"), F.col("lon").cast("string")),
    )
    container = F.when(
        F.col("event_type") == "click", F.create_map(F.lit("creation_time"), moment)
    )
    stream_tags = F.map_concat(
        F.coalesce(place, F.create_map(F.lit("x"), F.lit("y"))),
        F.create_map(F.lit("date"), moment),
    )

    def stream(kind: str, codec: str, w, h, tags):
        return F.struct(
            F.lit(kind).alias("codec_type"), F.lit(codec).alias("codec_name"),
            w.cast("int").alias("width"), h.cast("int").alias("height"),
            F.lit("25/1").alias("r_frame_rate"), tags.alias("tags"),
        )

    empty = F.create_map(F.lit("x"), F.lit("y"))
    probe = F.to_json(
        F.struct(
            F.struct(
                F.col("value").cast("string").alias("duration"),
                (k.cast("long") * 1000).cast("string").alias("bit_rate"),
                container.alias("tags"),
            ).alias("format"),
            F.array(
                stream("audio", "aac", F.lit(0), F.lit(0), empty),
                stream("video", "h264", k + 100, k + 50, stream_tags),
                stream("video", "mjpeg", F.lit(1), F.lit(1), empty),
            ).alias("streams"),
        )
    )
    rows = timeline(spark, d).select("media_id", probe.alias("probe"))
    return G.video_tags(rows).select(
        "media_id", "duration", "bitrate", "creation_time",
        F.col("position.lat").alias("lat"), F.col("position.lon").alias("lon"),
        "width", "height", "resolution", "codec", "fps",
    )


@query(
    "h13_exif_gps",
    """SELECT media_id, CASE WHEN ok THEN round(la, 6) END AS lat, CASE WHEN ok THEN round(lo, 6) END AS lon FROM (
         SELECT *, la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AND NOT (la = 0 AND lo = 0) AS ok FROM (
           SELECT media_id, (k + 30 / 60.0::DOUBLE + (k / 7.0::DOUBLE) / 3600) * CASE WHEN value < 40 THEN -1 ELSE 1 END AS la,
             -(k * 2 + k / 60.0::DOUBLE) AS lo FROM {timeline}))""",
)
def h13(spark, d):
    k = F.col("k")

    def rational(num, den):
        return F.struct(num.cast("long").alias("num"), den.cast("long").alias("den"))

    one = F.lit(1)
    tag = F.struct(
        F.when(F.col("value") < 40, "S").otherwise("N").alias("lat_ref"),
        F.array(rational(k, one), rational(F.lit(30), one), rational(k, F.lit(7))).alias("lat"),
        F.lit("W").alias("lon_ref"),
        # The seconds carry a zero denominator and count as 0.
        F.array(rational(k * 2, one), rational(k, one), rational(k, F.lit(0))).alias("lon"),
    ).cast(schemas.GPS_TAG)
    rows = timeline(spark, d).select("media_id", tag.alias("gps"))
    found = M.exif_gps(F.col("gps"))
    return rows.select(
        "media_id", F.round(found["lat"], 6).alias("lat"), F.round(found["lon"], 6).alias("lon")
    )


@query(
    "h22_h23_boxes",
    """SELECT media_id, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS x, k + 1 AS y, trunc(value)::INT AS w, 0 AS h,
         k AS cx, k AS cw, CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END AS ch, k = 0 OR k % 2 = 1 AS empty FROM {timeline}""",
)
def h22(spark, d):
    k = F.col("k")
    parts = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit('{"x": '), k)).otherwise(F.lit('{"z": 1')),
        F.lit(', "top": '), k + 1, F.lit(', "width": '), F.col("value").cast("int"), F.lit("}"),
    )
    box = M.box_from_json(parts)
    corner = M.box_from_corners(
        k + F.lit(0.75), F.lit(2.5), k * 2 + F.lit(0.25), F.when(k % 2 == 0, 7.9).otherwise(2.1)
    )
    return timeline(spark, d).select(
        "media_id", box["x"].alias("x"), box["y"].alias("y"), box["w"].alias("w"),
        box["h"].alias("h"), corner["x"].alias("cx"), corner["w"].alias("cw"),
        corner["h"].alias("ch"), M.is_empty_box(corner).alias("empty"),
    )


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Three detections per image, cut from its vector; negative heads lose their embedding."""
    e = F.col("embedding")

    def det(i: int, label: str):
        return F.struct(
            F.lit(label).alias("label"),
            (F.abs(F.get(e, i).cast("double")) * 4).alias("confidence"),
            F.when(F.get(e, i + 3) >= 0, F.slice(e, i + 1, 4))
            .otherwise(F.array().cast("array<float>"))
            .alias("embedding"),
        )

    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.array(det(0, "dog"), det(1, "cat"), det(2, "person")).alias("found"),
    )


DETECTIONS = """
  SELECT vec_id AS image_id, unnest(['dog', 'cat', 'person']) AS label, unnest([0, 1, 2]) AS p,
    unnest([abs(embedding[1]::DOUBLE) * 4, abs(embedding[2]::DOUBLE) * 4, abs(embedding[3]::DOUBLE) * 4]) AS confidence,
    unnest([embedding[4] >= 0, embedding[5] >= 0, embedding[6] >= 0]) AS has FROM embeddings"""


@query(
    "a16_b4_flatten_detections",
    f"""SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY p) - 1)::INT AS embedding_index, label,
          round(confidence, 6) AS confidence FROM ({DETECTIONS})
        WHERE confidence >= 0.4 AND has AND label IN ('dog', 'cat')""",
)
def a16(spark, d):
    rows = G.flatten_detections(detections(spark, d), "found", 0.4, labels=["dog", "cat"])
    return rows.select(
        "image_id", "embedding_index", "label", F.round("confidence", 6).alias("confidence")
    )


@query(
    "b4_not_person",
    f"""SELECT image_id, label FROM ({DETECTIONS}) WHERE confidence >= 0.5 AND has AND label <> 'person'""",
)
def b4(spark, d):
    return G.flatten_detections(detections(spark, d), "found", 0.5, exclude=["person"]).select(
        "image_id", "label"
    )


PRESENCE = f"""
  SELECT image_id, count(*) FILTER (label = 'dog' AND confidence >= 0.5) AS dog_count,
    count(*) FILTER (label = 'cat' AND confidence >= 0.5) AS cat_count FROM ({DETECTIONS}) GROUP BY image_id"""


@query(
    "d27_presence",
    f"""SELECT image_id, dog_count, cat_count, dog_count > 0 AS has_dog, cat_count > 0 AS has_cat,
          CASE WHEN dog_count > 0 AND cat_count > 0 THEN 'both' WHEN dog_count > 0 THEN 'dogs' WHEN cat_count > 0 THEN 'cats' END AS route
        FROM ({PRESENCE})""",
)
def d27(spark, d):
    from shutterlake.operators import stats as S

    return S.presence(detections(spark, d), "found")


@query(
    "d27_presence_totals",
    f"""SELECT count(*) AS n_photos, count(*) FILTER (dog_count > 0 AND cat_count = 0) AS only_dogs,
          count(*) FILTER (cat_count > 0 AND dog_count = 0) AS only_cats,
          count(*) FILTER (cat_count > 0 AND dog_count > 0) AS both,
          sum(dog_count)::BIGINT AS n_dogs, sum(cat_count)::BIGINT AS n_cats FROM ({PRESENCE})""",
)
def d27_totals(spark, d):
    from shutterlake.operators import stats as S

    return S.presence_totals(S.presence(detections(spark, d), "found"))


@query(
    "d33_label_set",
    "SELECT media_id, CASE WHEN k % 2 = 0 THEN event_type ELSE least(event_type, 'dog') || '|' || greatest(event_type, 'dog') END AS labels FROM {timeline}",
)
def d33(spark, d):
    a = F.struct(F.col("event_type").alias("label"))
    b = F.struct(F.when(F.col("k") % 2 == 0, F.col("event_type")).otherwise("dog").alias("label"))
    rows = timeline(spark, d).select("media_id", F.array(b, a, a).alias("found"))
    return G.label_set(rows, "found").select(
        "media_id", F.array_join("labels", "|").alias("labels")
    )


@query(
    "a13_gallery_shapes",
    """SELECT vec_id AS id, p::INT AS position, CASE p WHEN 0 THEN 'a' ELSE 'b' END || label AS label,
         round(list_sum(embedding::DOUBLE[]), 4) AS total, shape
       FROM embeddings, (SELECT unnest([0, 1]) AS p), (SELECT unnest(['list', 'columns']) AS shape)""",
)
def a13(spark, d):
    e = table(spark, d, "embeddings")
    names = F.array(F.concat(F.lit("a"), "label"), F.concat(F.lit("b"), "label"))
    entry = [
        F.struct(F.get(names, i).alias("label"), F.col("embedding")) for i in range(2)
    ]
    listed = e.select(F.col("vec_id").alias("id"), F.to_json(F.array(*entry)).alias("j"))
    packed = F.struct(
        names.alias("labels"), F.array("embedding", "embedding").alias("embeddings")
    )
    columns = e.select(F.col("vec_id").alias("id"), F.to_json(packed).alias("j"))
    both = G.gallery_from_list(listed, "j").withColumn("shape", F.lit("list")).unionByName(
        G.gallery_from_columns(columns, "j").withColumn("shape", F.lit("columns"))
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return both.select("id", "position", "label", F.round(total, 4).alias("total"), "shape")


@query(
    "b8_usable_vectors",
    """SELECT image_id, label FROM (SELECT *, label AS l FROM (""" + DETECTIONS + """)) WHERE has""",
)
def b8(spark, d):
    rows = detections(spark, d).select("image_id", F.explode("found").alias("f")).select(
        "image_id", "f.*"
    )
    trimmed = V.trim_vector(F.col("embedding"), F.lit(3))
    return rows.where(V.usable_vector(F.col("embedding"), 4) & V.usable_vector(trimmed, 3)).select(
        "image_id", "label"
    )
