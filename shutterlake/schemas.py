"""Column layouts of the tables the operators read and write (Spark DDL)."""

LISTING = "path STRING, length BIGINT, modificationTime TIMESTAMP"

MEDIA = (
    "media_id BIGINT, path STRING, sha256 STRING, size_bytes BIGINT, width INT, height INT, "
    "orientation INT, resolution BIGINT, ts TIMESTAMP_NTZ, gps STRUCT<lat:DOUBLE,lon:DOUBLE>, "
    "phash BIGINT, location_name STRING, face_count INT, pet_count INT, "
    "last_scanned_at TIMESTAMP_NTZ, is_missing BOOLEAN, kind STRING"
)

FACES = (
    "id BIGINT, media_id BIGINT, cluster_id BIGINT, embedding_index INT, embedding ARRAY<FLOAT>, "
    "embedding_dim INT, bbox STRUCT<x:INT,y:INT,w:INT,h:INT>, detection_confidence DOUBLE, "
    "model_name STRING, detector STRING, thumbnail_path STRING"
)

PETS = FACES + ", species STRING"

CLUSTERS = (
    "id BIGINT, display_name STRING, description STRING, primary_id BIGINT, is_hidden BOOLEAN"
)

PET_CLUSTERS = CLUSTERS + ", species STRING"

SUGGESTIONS = (
    "id BIGINT, face_id BIGINT, suggested_cluster_id BIGINT, distance DOUBLE, reason STRING, "
    "status STRING, reviewed_at TIMESTAMP_NTZ"
)

MERGE_EVENTS = (
    "source_cluster_id BIGINT, target_cluster_id BIGINT, merged_at TIMESTAMP_NTZ, "
    "initiated_by STRING, notes STRING"
)

DELETE_LOG = (
    "media_id BIGINT, face_id BIGINT, original_path STRING, trash_path STRING, "
    "deleted_at TIMESTAMP_NTZ, session_id STRING"
)

PAIRS = "original STRING, duplicate STRING"

ACTION_PLAN = "action STRING, src STRING, dst STRING, reason STRING"

GPS_TAG = (
    "STRUCT<lat_ref:STRING, lat:ARRAY<STRUCT<num:BIGINT,den:BIGINT>>, "
    "lon_ref:STRING, lon:ARRAY<STRUCT<num:BIGINT,den:BIGINT>>>"
)

PROBE = (
    "STRUCT<format:STRUCT<duration:STRING, bit_rate:STRING, tags:MAP<STRING,STRING>>, "
    "streams:ARRAY<STRUCT<codec_type:STRING, codec_name:STRING, width:INT, height:INT, "
    "r_frame_rate:STRING, tags:MAP<STRING,STRING>>>>"
)

GALLERY_LIST = "ARRAY<STRUCT<label:STRING, embedding:ARRAY<FLOAT>>>"
GALLERY_COLUMNS = "STRUCT<labels:ARRAY<STRING>, embeddings:ARRAY<ARRAY<FLOAT>>>"

BOX = "STRUCT<x:INT, y:INT, w:INT, h:INT, left:INT, top:INT, width:INT, height:INT>"
