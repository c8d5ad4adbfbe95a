"""Text functions of reports and pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[uncertain]"


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends (``trim`` takes blanks only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def anchor(c: Column) -> Column:
    """Heading text as an anchor: lower case, punctuation dropped, blanks as hyphens."""
    return F.replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9\x{4e00}-\x{9fff} _-]", ""), F.lit(" "), F.lit("-"))


def file_slug(c: Column) -> Column:
    """Name as a file stem: blanks as underscores, all but letters, digits, ``_`` and ``-`` dropped."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"\s+", "_"), r"[^A-Za-z0-9_-]", "")


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def normalise(c: Column) -> Column:
    """No-break spaces and runs of blanks as one blank, none around line ends or at the ends, no blank lines."""
    out = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"[ \t\f\r]+", " ")
    return strip(F.regexp_replace(out, r"\s*\n\s*", "\n"))


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something is cut."""
    return F.when(F.char_length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(c)


def compact(c: Column, most: int = 80) -> Column:
    """One line for a table cell: trimmed non-blank lines joined by blanks, then cut."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), strip), lambda x: x != "")
    return F.substring(F.array_join(lines, " "), 1, most)


def swap_extension(c: Column, ext: str) -> Column:
    """Path with another extension, or with it added where there is none."""
    return F.when(c.rlike(r"[.][^./]+$"), F.regexp_replace(c, r"[.][^./]+$", ext)).otherwise(F.concat(c, F.lit(ext)))


def stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(.)[.][^.]*$", "$1")


def escape_html(c: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


TONES = ("neutral", "accent", "positive", "warning", "danger", "info")


def tone(c: Column) -> Column:
    return F.when(c.isin(*TONES), c).otherwise(F.lit("accent"))


def item_name(name: Column, item: Column, slug: Column) -> Column:
    """``name``, else ``item``, else the slug as words. ``initcap`` starts words at blanks only."""
    filled = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(filled(name), filled(item), F.initcap(F.translate(slug, "_-", "  ")))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(100.0)).otherwise(part * F.lit(100.0) / whole)


def one_decimal(c: Column) -> Column:
    return F.call_function("format_number", c, F.lit("0.0"))


def file_size(c: Column) -> Column:
    """``n B`` under 1024, else kilobytes with one decimal."""
    return F.when(c >= 1024, F.concat(F.call_function("format_number", c / 1024, F.lit("0.0")), F.lit(" KB"))).otherwise(F.concat(c.cast("string"), F.lit(" B")))


def pad(c: Column, width: Column) -> Column:
    """Padded on the right, never cut."""
    return F.rpad(c, F.greatest(F.char_length(c), width), F.lit(" "))


def zero_pad(c: Column, width: int) -> Column:
    s = c.cast("string")
    return F.lpad(s, F.greatest(F.char_length(s), F.lit(width)), F.lit("0"))


def is_uncertain(value: Column, listed: Column | None = None) -> Column:
    """Null, blank, marked, or listed as uncertain."""
    out = value.isNull() | (strip(value) == "") | value.contains(MARK)
    return F.coalesce(out if listed is None else out | F.coalesce(listed, F.lit(False)), F.lit(True))


def source_line(n: Column, url: Column, title: Column, note: Column) -> Column:
    """``[n] url — note``, the title standing for the note where there is one."""
    said = F.coalesce(F.nullif(title, F.lit("")), F.nullif(note, F.lit("")))
    return F.concat(F.format_string("[%d] ", n), F.coalesce(url, F.lit("")), F.coalesce(F.concat(F.lit(" — "), said), F.lit("")))
