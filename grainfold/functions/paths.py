"""Path, link-target and naming expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading or trailing white space in the Unicode sense.
EDGES = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def unbracketed(c: Column) -> Column:
    """Without one enclosing pair of angle brackets."""
    return F.when(F.startswith(c, F.lit("<")) & F.endswith(c, F.lit(">")) & (F.char_length(c) >= 2), F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(c)


def percent_decoded(c: Column) -> Column:
    """As written where the percent signs aren't well-formed; '+' stays."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    broken = F.contains(decoded, F.lit("\ufffd")) & ~F.contains(c, F.lit("\ufffd"))
    return F.when(decoded.isNull() | broken, c).otherwise(decoded)


def before_first(c: Column, sign: str) -> Column:
    return F.substring_index(c, sign, 1)


def directory(c: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))


def parent(c: Column) -> Column:
    return directory(c)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def normalised(c: Column) -> Column:
    """Segments with '.', '..' and empty ones resolved; NULL if the path leaves the root."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")


def has_scheme(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def link_path(target: Column, source_dir: Column) -> Column:
    """Path of a trimmed, unbracketed link target: decoded, without fragment and query, resolved, without a leading ``wiki/``."""
    path = before_first(before_first(percent_decoded(target), "#"), "?")
    full = F.when(F.startswith(path, F.lit("/")) | (source_dir == ""), path).otherwise(F.concat_ws("/", source_dir, path))
    return F.regexp_replace(normalised(full), "^wiki/", "")


def concept_of_link(target: Column, source_dir: Column) -> Column:
    """Concept id that a link target names, or NULL (URL, empty, not ``.md``, or outside the root)."""
    bare = trimmed(unbracketed(trimmed(target)))
    path = link_path(bare, source_dir)
    return F.when((bare != "") & ~has_scheme(bare) & F.endswith(path, F.lit(".md")), F.regexp_replace(path, r"\.md$", ""))


def encoded_target(c: Column) -> Column:
    """Angle brackets around a target that has white space or parentheses."""
    return F.when(c.rlike(r"[\s()]"), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(c)
