"""Text cleaning, masking and url functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First characters that a spreadsheet reads as a formula.
FORMULA_PREFIX = r"(?U)^\s*[=+\-@]"
CONTROL_PREFIX = r"^[\t\r]"
# Fixed value: all white space of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column) -> Column:
    """Without white space at both ends, that of other scripts included."""
    return F.btrim(value.cast("string"), F.lit(WHITE_SPACE))


def clean_text(value: Column) -> Column:
    """Trim; empty text becomes null."""
    return F.nullif(strip(value), F.lit(""))


def clean_code(value: Column) -> Column:
    """Trimmed upper-case code; empty becomes null."""
    return F.upper(clean_text(value))


def non_negative_int(value: Column) -> Column:
    """Whole non-negative number or null."""
    digits = F.regexp_extract(value.cast("string"), r"(?U)^\s*\+?([0-9]+)\s*$", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def clean_code_list(values: Column) -> Column:
    """Sorted distinct upper-case codes of an array; null gives an empty array."""
    codes = F.transform(values, lambda c: F.upper(strip(c)))
    return F.coalesce(F.array_sort(F.array_distinct(codes)), F.array().cast("array<string>"))


def clean_tags(values: Column, width: int = 40) -> Column:
    """Sorted distinct trimmed tags, each at most ``width`` characters."""
    kept = F.filter(F.transform(values, strip), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.transform(kept, lambda t: F.substring(t, 1, width))))


def append_unique(values: Column, item: Column, most: int = 100) -> Column:
    """A list with an item at its end, unless it holds the item or the item is null; the last ``most`` stay.

    The bound belongs to the contract of the list.
    """
    known = F.coalesce(values, F.array().cast("array<string>"))
    longer = F.when(item.isNull() | F.array_contains(known, item), known).otherwise(F.array_append(known, item))
    return F.slice(longer, F.greatest(F.size(longer) - most + 1, F.lit(1)), F.lit(most))


def merged_map(old: Column, new: Column) -> Column:
    """Both maps in one; of a key that both have, the new value. A null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    late = F.coalesce(new, empty)
    kept = F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.map_contains_key(late, k))
    return F.map_concat(kept, late)


def redact_shape(value: Column, width: int = 32) -> Column:
    """Shape of a text without its content: digits ``#``, letters ``a``."""
    head = F.substring(strip(value), 1, width)
    shape = F.regexp_replace(F.regexp_replace(head, r"\p{Nd}", "#"), r"\p{L}", "a")
    return F.when(shape == "", F.lit("empty")).otherwise(shape)


def mask_text(value: Column, keep: int = 4) -> Column:
    """Keep the last characters of a destination, hide the rest."""
    return F.when(F.length(value) <= keep, F.lit("****")).otherwise(
        F.concat(F.lit("****"), F.substring(value, -keep, keep))
    )


def csv_safe(value: Column) -> Column:
    """Put a quote before text that a spreadsheet could run as a formula."""
    risky = value.rlike(FORMULA_PREFIX) | value.rlike(CONTROL_PREFIX)
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def strip_url(url: Column) -> Column:
    """Scheme, lower-case host, port and path; no user, query or fragment."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^//([^/]*)", 1), r"^.*@", "")
    path = F.regexp_replace(rest, r"^//[^/]*", "")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(authority != "", F.concat(F.lit("//"), F.lower(authority))).otherwise(F.lit("")),
        path,
    )


def display_name(value: Column) -> Column:
    """Collapse white space; empty becomes null."""
    return clean_text(F.regexp_replace(value, r"(?U)\s+", " "))


def slug_base(text: Column, identifier: Column, width: int = 64) -> Column:
    """A stable name made from the part before ``@``, never empty or too short."""
    raw = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    local = F.regexp_extract(raw, r"^([^@]*)", 1)
    name = F.regexp_replace(local, r"[^a-z0-9_.\-]+", "-")
    name = F.regexp_replace(name, r"^[._\-]+|[._\-]+$", "")
    name = F.when(name == "", F.lit("user")).otherwise(name)
    name = F.when(F.length(name) < 3, F.concat(F.lit("user-"), name)).otherwise(name)
    name = F.regexp_replace(F.substring(name, 1, width), r"[._\-]+$", "")
    hexed = F.substring(F.regexp_replace(identifier.cast("string"), "-", ""), 1, 8)
    return F.when(raw == "", F.concat(F.lit("user-"), hexed)).otherwise(name)
