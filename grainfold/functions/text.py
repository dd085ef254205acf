"""Text expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lifecycle words of the older format with their present ones, reasons for ignoring a file, media types by suffix.
STATUS = {"current": "stable", "superseded": "deprecated"}
REASONS = {
    "unsupported": "unsupported file type", "reserved": "reserved filename", "encrypted": "encrypted document",
    "extraction_failed": "extraction failed", "empty": "no extractable text", "io_failed": "read/write failed",
}
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}


def lookup(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), c)


def collapsed(c: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits longer than two characters, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.char_length(t) > 2)


def migrated_status(c: Column) -> Column:
    """The present word for an older status, or NULL if it needs no change."""
    return lookup(STATUS, F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))


def slug(title: Column, resource: Column) -> Column:
    """Id made of the title, else of the last path segment, else of the host; at most 40 characters."""
    is_url = resource.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    after = F.regexp_replace(resource, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.when(is_url, F.regexp_replace(F.regexp_replace(after, "[?#].*$", ""), "^[^/]*", "")).otherwise(resource)
    host = F.when(is_url, F.regexp_extract(after, "^([^/?#:]*)", 1)).otherwise(F.lit(""))
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda s: F.trim(s) != ""), F.lit(-1))
    base = F.coalesce(title, last, host)
    made = F.regexp_replace(F.substring(F.regexp_replace(F.lower(base), r"[^\p{L}\p{N}]+", "-"), 1, 40), "^-+|-+$", "")
    return F.when(made == "", "source").otherwise(made)


def stripped_markup(c: Column) -> Column:
    """Text of HTML or XML without scripts, styles, comments and tags; the basic entities decoded, '&amp;' first."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")


def code_fence(code: Column, language: Column) -> Column:
    """Code between marks that are longer than any run of backticks in it."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), F.char_length)
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(mark, F.coalesce(language, F.lit("")), F.lit("\n"), code, F.lit("\n"), mark)


def column_name(n: Column) -> Column:
    """Spreadsheet name of a column from 1 on (1 A, 27 AA)."""
    acc = F.struct(n.cast("bigint").alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).cast("bigint").alias("n"), F.concat(F.char(F.lit(65) + (a["n"] - 1) % 26), a["s"]).alias("s"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), acc, step, lambda a: a["s"])


def is_section_label(c: Column) -> Column:
    """Short line without a sentence end that closes with parentheses, of 3 to 14 words."""
    words = F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))
    return (F.char_length(c) <= 100) & ~c.rlike(r"[.!?;:]$") & c.rlike(r"\([^()]*\)$") & words.between(3, 14)


def matchable(c: Column) -> Column:
    """Lower case, decimal commas as points, no white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(\d),(\d)", "$1.$2"), r"(?U)\s+", "")


def shortened(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)
