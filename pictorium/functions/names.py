"""File-name expressions: suffixes, media kinds, derived and safe names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes that a listing accepts, and those that an upload accepts.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".tiff", ".tif")
VIDEO_SUFFIXES = (".mp4", ".mov", ".avi", ".mkv", ".m4v", ".webm")
UPLOAD_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".gif")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024

_SUFFIX = r"(?s)^.+(\.[^.]+)$"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Last dot and what follows, case kept; empty for dot-files and trailing dots."""
    return F.regexp_extract(name, _SUFFIX, 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix(name)))


def file_extension(name: Column) -> Column:
    return F.lower(suffix(name))


def is_image(extension: Column) -> Column:
    return extension.isin(*IMAGE_SUFFIXES)


def is_video(extension: Column) -> Column:
    return extension.isin(*VIDEO_SUFFIXES)


def media_type(extension: Column) -> Column:
    return F.when(is_image(extension), "image").when(is_video(extension), "video").otherwise("other")


def thumbnail_name(name: Column) -> Column:
    """``stem_EXT.jpg``: the suffix stays in the name so that twins with one stem do not meet."""
    return F.concat(stem(name), F.lit("_"), F.ltrim(suffix(name), F.lit(".")), F.lit(".jpg"))


def upload_name(name: Column, at: Column) -> Column:
    """``upload_<time>_<stem with unsafe characters replaced><suffix>``."""
    clean = F.regexp_replace(stem(name), "[^a-zA-Z0-9_-]", "_")
    return F.concat(F.lit("upload_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), clean, file_extension(name))


def trash_name(name: Column, at: Column) -> Column:
    """Name under which a deleted file is kept."""
    return F.concat(stem(name), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), suffix(name))


def is_valid_name(name: Column) -> Column:
    """A plain file name: no parent steps, no separators."""
    unsafe = F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\"))
    return F.coalesce(~unsafe & (name != "."), F.lit(False))


def is_valid_album(name: Column, root: str) -> Column:
    """An album path stays below its root: no parent steps, and absolute only inside the root."""
    inside = (name == root) | F.startswith(name, F.lit(root.rstrip("/") + "/"))
    escapes = F.contains(name, F.lit("..")) | (F.startswith(name, F.lit("/")) & ~inside)
    return F.coalesce(~escapes, F.lit(False))


def upload_rejection(extension: Column, size: Column) -> Column:
    """Why an upload is refused; NULL when it is admitted."""
    return (
        F.when(~extension.isin(*UPLOAD_SUFFIXES), "unsupported_type")
        .when(size > MAX_UPLOAD_BYTES, "too_large")
    )


def album_of(path: Column, root: Column) -> Column:
    """First directory below the root; empty for files that lie in the root itself."""
    below = F.substr(path, F.length(root) + 2)
    return F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1)).otherwise("")


def is_listed(name: Column) -> Column:
    """Listings leave out names that start with a dot or an underscore."""
    return ~name.startswith(".") & ~name.startswith("_")
