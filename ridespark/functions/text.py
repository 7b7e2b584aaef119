"""Paths and directives in hand-written lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: recognized file endings
AUDIO_ENDINGS = ("mp3", "wav", "ogg", "flac")
VIDEO_ENDINGS = ("mp4", "mov", "mkv", "avi")


def _ends_with(text: Column, endings: tuple[str, ...]) -> Column:
    return F.lower(F.trim(text)).rlike(rf"[^/\\]\.({'|'.join(endings)})$")


def is_video(text: Column) -> Column:
    return _ends_with(text, VIDEO_ENDINGS)


def without_star(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s*\*$", "")


def is_audio(text: Column) -> Column:
    """True for an audio path, with or without the trailing mix marker ``*``."""
    return _ends_with(without_star(text), AUDIO_ENDINGS)


def has_star(text: Column) -> Column:
    return F.trim(text).endswith("*")


def path_kind(text: Column) -> Column:
    return F.when(is_audio(text), "audio").when(is_video(text), "video").otherwise("other")


def parent_folder(path: Column) -> Column:
    """Name of the folder a path lies in, for ``/`` and ``\\`` paths alike; else empty."""
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)/[^/]*$", 1)


def resolve_against(path: Column, file: Column) -> Column:
    """`path` as is when absolute, else next to `file`."""
    absolute = path.rlike(r"^([/\\]|[A-Za-z]:|[a-z]+:/)")
    folder = F.regexp_extract(file, r"^(.*/)[^/]*$", 1)
    return F.when(absolute, path).otherwise(F.concat(folder, path))
