"""Path and name expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recognised file extensions.
IMAGE_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".heic", ".heif", ".raw", ".cr2", ".nef",
    ".tiff", ".tif", ".bmp", ".gif", ".webp", ".jfif",
)
VIDEO_EXTENSIONS = (
    ".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v",
    ".mpg", ".mpeg", ".3gp", ".3g2", ".mts", ".m2ts", ".vob", ".ogv",
    ".ts", ".divx", ".xvid", ".f4v", ".asf", ".rm", ".rmvb",
)
MEDIA_EXTENSIONS = IMAGE_EXTENSIONS + VIDEO_EXTENSIONS

# Size classes in MB, upper bound first.
SIZE_BUCKETS = ((1, "1-Small_Under1MB"), (5, "2-Medium_1-5MB"), (15, "3-Large_5-15MB"))
SIZE_BUCKET_TOP = "4-XL_Over15MB"
SIZE_BUCKET_UNKNOWN = "0-Unknown_Size"

# Path fragments that mark a sync provider, tried in this order.
SYNC_MARKERS = (
    ("onedrive", ("onedrive",)),
    ("googledrive", ("google drive", "googledrive")),
    ("dropbox", ("dropbox",)),
    ("icloud", ("icloud",)),
)

MB = 1024 * 1024


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty when the name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def raw_suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1)


def has_extension(path: Column, extensions: Iterable[str] = MEDIA_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def is_video(path: Column) -> Column:
    return has_extension(path, VIDEO_EXTENSIONS)


def under(path: Column, roots: Iterable[str]) -> Column:
    """True when the path lies below one of the roots."""
    test = F.lit(False)
    for root in roots:
        test = test | F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return test


def has_part(path: Column, names: Iterable[str]) -> Column:
    """True when one path component equals an excluded name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def is_sync_conflict(path: Column) -> Column:
    """Names that sync clients give to conflicting copies."""
    numbered = stem(path).rlike(r"-.*-[0-9]+$")
    marked = F.lower(file_name(path)).contains("conflicted copy")
    copied = file_name(path).rlike(r"\(\s*[0-9]+\s*\)(\.[^.()]+)?$")
    return numbered | marked | copied


def sync_provider(path: Column) -> Column:
    low = F.lower(path)
    out = None
    for name, marks in SYNC_MARKERS:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | low.contains(mark)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def location_slug(address: Column) -> Column:
    """Folder-safe text before the first comma; `Unknown` when nothing is left."""
    head = F.trim(F.substring_index(address, ",", 1))
    kept = F.trim(F.regexp_replace(head, r"[^\p{L}\p{N} _-]", ""))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("Unknown"))


def size_bucket(size_bytes: Column) -> Column:
    mb = size_bytes / F.lit(MB)
    out = F.when(size_bytes.isNull(), SIZE_BUCKET_UNKNOWN)
    for top, name in SIZE_BUCKETS:
        out = out.when(mb < top, name)
    return out.otherwise(SIZE_BUCKET_TOP)


def target_folder(ts: Column, address: Column, size_bytes: Column, mtime: Column) -> Column:
    """year/MM-Month[/place], or the Unknown_Metadata tree for undated files."""
    slug = location_slug(address)
    place = F.when(slug != "Unknown", slug)

    def month(t: Column) -> Column:
        return F.date_format(t, "MM-MMMM")

    def year(t: Column) -> Column:
        return F.year(t).cast("string")

    undated = F.concat_ws(
        "/",
        F.lit("Unknown_Metadata"),
        size_bucket(size_bytes),
        F.coalesce(year(mtime), F.lit("Unknown_Date")),
        F.coalesce(month(mtime), F.lit("Unknown_Date")),
        place,
    )
    return F.when(ts.isNull(), undated).otherwise(F.concat_ws("/", year(ts), month(ts), place))


def suffixed_name(name: Column, number: Column, style: str) -> Column:
    """`name_1.ext`, `name_dup1.ext` or `name (1).ext`; number 0 keeps the name."""
    shape = {"plain": "%s_%d%s", "dup": "%s_dup%d%s", "paren": "%s (%d)%s"}[style]
    return F.when(number == 0, name).otherwise(
        F.format_string(shape, stem(name), number, raw_suffix(name))
    )
