"""Keys, metadata and statuses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND, DELETED, NOT_FOUND = "found", "deleted", "not_found"


def key_of_long(k: Column) -> Column:
    """8-byte big-endian key of a non-negative number; sorts like the number."""
    return F.unhex(F.lpad(F.hex(k), 16, "0"))


def meta(**attributes: Column) -> Column:
    """Metadata map of UTF-8 values."""
    pairs = [x for name, value in attributes.items() for x in (F.lit(name), F.encode(value, "utf-8"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,binary>")


def meta_insert(m: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != name), F.create_map(F.lit(name), value))


def meta_canon(m: Column) -> Column:
    """A string equal for equal maps only, whatever the order of insertion."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(F.hex(F.encode(e.key, "utf-8")), F.lit(":"), F.hex(e.value))))
    return F.array_join(entries, ",")


def status(is_deleted: Column) -> Column:
    return F.when(is_deleted.isNull(), NOT_FOUND).when(is_deleted, DELETED).otherwise(FOUND)


def latest_of(a: Column, b: Column) -> Column:
    """The later of two results (structs with ``status`` and ``timestamp``): a
    tie keeps a, not_found lies below every timestamp."""
    later = (b["status"] != NOT_FOUND) & ((a["status"] == NOT_FOUND) | (b["timestamp"] > a["timestamp"]))
    return F.when(later, b).otherwise(a)


def is_found(result_status: Column) -> Column:
    return result_status == FOUND


def is_deleted(result_status: Column) -> Column:
    return result_status == DELETED


def is_not_found(result_status: Column) -> Column:
    return result_status == NOT_FOUND


def map_found(result_status: Column, value: Column, f) -> Column:
    """f of a found value; deleted and not found stay without one."""
    return F.when(result_status == FOUND, f(value))


def cast_absent(result_status: Column, kind: str) -> Column:
    """The value, of another type, of a result that has none; a found one fails the query."""
    return F.when(result_status != FOUND, F.lit(None).cast(kind)).otherwise(F.raise_error(F.lit("result is found")).cast(kind))


def into_option(result_status: Column, value: Column) -> Column:
    return F.when(result_status == FOUND, value)


def unwrap(result_status: Column, value: Column) -> Column:
    """The value of a found result; any other status fails the query."""
    return F.when(result_status == FOUND, value).otherwise(F.raise_error(F.concat(F.lit("result is "), result_status)).cast("binary"))
