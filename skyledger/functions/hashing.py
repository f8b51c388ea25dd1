"""Stable fingerprints of column sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the JSON object of the given fields, keys sorted, nulls kept."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def compact_key(**fields: Column) -> Column:
    """First 128 bits of the fingerprint, for keys that travel with every row."""
    return F.substring(F.unhex(fingerprint(**fields)), 1, 16)


def combine_fingerprints(values: Column) -> Column:
    """One hash for an array of hashes, order and repeats ignored."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), ","), 256)
