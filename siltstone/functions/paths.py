"""Path and pattern functions on columns; paths are POSIX, without a trailing slash."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    """The last segment."""
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """The path without its last segment; empty for a first-level path."""
    return F.regexp_replace(path, "/[^/]*$", "")


def depth_of(path: Column) -> Column:
    """The number of segments."""
    return F.size(F.split(path, "/")) - 1


def ext_of(name: Column) -> Column:
    """The last suffix in lower case; empty for dot files and names ending in a dot."""
    return F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))


def segments_of(path: Column) -> Column:
    """Segments in lower case."""
    return F.split(F.lower(path), "/")


def has_segment(path: Column, segment: str) -> Column:
    """Whether a segment equals ``segment``, whatever its case."""
    return F.array_contains(segments_of(path), segment.lower())


def ancestors_of(path: Column) -> Column:
    """All proper ancestors from the first level down, as an array."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def proper_ancestors(path: Column) -> Column:
    """ancestors_of, empty for first-level paths."""
    return F.when(depth_of(path) > 1, ancestors_of(path)).otherwise(F.array().cast("array<string>"))


def in_subtree(path: Column, root: str) -> Column:
    """The root itself and all below it, as ranges that reach the scan ('0' follows '/')."""
    return (path == root) | ((path >= f"{root}/") & (path < f"{root}0"))


def like_of_glob(glob: str) -> str:
    """A LIKE pattern for ``*`` and ``?``; ``%`` and ``_`` stay wild, brackets are literal."""
    return glob.lower().replace("*", "%").replace("?", "_")


def matches_glob(path: Column, glob: str) -> Column:
    """Path filter of the inventory: ``*`` also crosses slashes."""
    return F.lower(path).like(like_of_glob(glob))


def regex_of_pattern(pattern: str) -> str:
    """A Java regular expression for a safety pattern: ``re:`` searches, anything else is a glob with classes over the whole path."""
    if pattern.startswith("re:"):
        return f"(?is){pattern[3:]}"
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            stop = pattern.index("]", i + 2)
            inner = pattern[i + 1 : stop].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            i = stop
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?is)^{''.join(out)}$"


def matches_any(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any safety pattern matches; local extended-length prefixes are left out first."""
    if not patterns:
        return F.lit(False)
    bare = F.regexp_replace(path, r"^(//\?/|\\\\\?\\)(?!UNC)", "")
    one = "|".join(f"(?:{regex_of_pattern(p)})" for p in patterns)
    return bare.rlike(one)


def under_any(path: Column, roots: tuple[str, ...]) -> Column:
    """Whether the path is one of the roots or below one, whatever the case."""
    low = F.lower(path)
    out = F.lit(False)
    for r in roots:
        out = out | (low == r.lower()) | low.startswith(r.lower() + "/")
    return out


def is_network_path(path: Column) -> Column:
    """UNC forms, with slashes of either kind."""
    p = F.translate(path, "\\", "/")
    plain = p.startswith("//") & ~p.startswith("//?/") & ~p.startswith("//./")
    return plain | F.lower(p).startswith("//?/unc/")


def in_downloads_or_temp(path: Column) -> Column:
    """Whether a segment is downloads or temp."""
    return F.arrays_overlap(segments_of(path), F.array(F.lit("downloads"), F.lit("temp")))


def is_volume_root(path: Column) -> Column:
    """First-level paths."""
    return depth_of(path) == 1
