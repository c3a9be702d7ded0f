"""Path expressions: stems, extensions, safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Audio suffixes accepted as they are; anything else becomes .flac.
KNOWN_EXTENSIONS = (".flac", ".wav", ".mp3", ".ogg", ".opus")
DEFAULT_EXTENSION = ".flac"


def base_name(path: Column) -> Column:
    """Last part of the path, ignoring trailing slashes."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """Last dot-suffix of the name; none for dot-files and a trailing dot."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """Name without its last suffix."""
    name = base_name(path)
    ending = suffix(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ending))


def extension(path: Column) -> Column:
    """Lower-cased audio suffix, or the default."""
    guess = F.lower(suffix(path))
    return F.when(guess.isin(*KNOWN_EXTENSIONS), guess).otherwise(F.lit(DEFAULT_EXTENSION))


def derive_id(row_id: Column, inline_path: Column, fallback: Column) -> Column:
    """Stem of the given ID, else of the inline path, else a content digest."""
    given = F.nullif(row_id.cast("string"), F.lit(""))
    inline = F.nullif(inline_path, F.lit(""))
    return F.coalesce(stem(given), stem(inline), F.sha2(fallback, 256))


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def is_safe(path: Column) -> Column:
    """Relative, non-empty and free of parent references."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    safe = ~path.startswith("/") & ~F.array_contains(parts, "..") & (F.size(parts) > 0)
    return F.coalesce(safe, F.lit(False))
