"""Canonical identifiers as column expressions.

Text is trimmed, upper-cased and has its blanks collapsed before anything else, so a
null and an empty cell meet as ``''``.  ``_`` separates the atoms of a composite key;
colours swap their own separators for ``-`` so the key stays unambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspan import params as P

BRANDED = r"^(.+?)_(\d+)_(\d+)_(.+)$"
SIZED = r"^(\d+)_(\d+)_(.+)_(\d+)$"
ITEM_LONG = r"^(\d+)-(\d+)-([A-Z]+)-(\d+)-(\d+)$"
ITEM_SHORT = r"^(\d+)-(\d+)-(\d+)$"


def text(value: Column) -> Column:
    blanks_collapsed = F.regexp_replace(F.upper(F.coalesce(value.cast("string"), F.lit(""))), r"\s+", " ")
    return F.trim(blanks_collapsed)


def store_code(value: Column) -> Column:
    return F.replace(text(value), F.lit(" "), F.lit(""))


def colour(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(value), r"[\s/_\-]+", "-"), r"^-+|-+$", "")


def size(value: Column) -> Column:
    label = text(value)
    whole = F.regexp_replace(F.regexp_replace(label, r"\.0+$", ""), r"^0+(?=\d)", "")
    return F.when(label.rlike(r"^\d+(\.0+)?$"), whole).otherwise(label)


def city(value: Column) -> Column:
    return text(value)


def zone(value: Column) -> Column:
    return F.trim(F.regexp_replace(text(value), r"\s*ZONE\s*$", ""))


def size_scale(value: Column) -> Column:
    label = size(value)
    number = F.when(label.rlike(r"^\d+$"), label.try_cast("bigint"))
    scale = F.lit("UNKNOWN")
    for name, (low, high) in reversed(P.SIZE_SCALES.items()):
        scale = F.when(number.between(low, high), F.lit(name)).otherwise(scale)
    return scale


def style_uid(dns: Column, item: Column) -> Column:
    return F.concat_ws("_", text(dns), text(item))


def option_uid(dns: Column, item: Column, colour_name: Column) -> Column:
    return F.concat_ws("_", text(dns), text(item), colour(colour_name))


def sku_uid(dns: Column, item: Column, colour_name: Column, size_label: Column) -> Column:
    return F.concat_ws("_", text(dns), text(item), colour(colour_name), size(size_label))


def split_dns_item(value: Column) -> tuple[Column, Column]:
    """Everything before the first ``_`` and everything after it."""
    parts = F.split(text(value), "_", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def _when_ok(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.lit(""))


def branded_key(value: Column) -> dict[str, Column]:
    """``BRAND_dns_item_COLOUR``; the colour may itself hold separators."""
    label = text(value)
    ok = label.rlike(BRANDED)
    part = lambda i: F.regexp_extract(label, BRANDED, i)
    return {
        "ok": ok,
        "brand": F.trim(part(1)),
        "dns": part(2),
        "item": part(3),
        "colour": _when_ok(ok, colour(part(4))),
        "option_uid": _when_ok(ok, option_uid(part(2), part(3), part(4))),
    }


def sized_key(value: Column) -> dict[str, Column]:
    """``dns_item_COLOUR_size``; the last number is the size."""
    label = text(value)
    ok = label.rlike(SIZED)
    part = lambda i: F.regexp_extract(label, SIZED, i)
    return {
        "ok": ok,
        "dns": part(1),
        "item": part(2),
        "colour": _when_ok(ok, colour(part(3))),
        "size": size(part(4)),
        "sku_uid": _when_ok(ok, sku_uid(part(1), part(2), part(3), part(4))),
    }


def itemnumber(value: Column) -> dict[str, Column]:
    """Five-part item numbers carry a colour code and a size; three-part ones carry neither."""
    label = text(value)
    is_long, is_short = label.rlike(ITEM_LONG), label.rlike(ITEM_SHORT)
    long_part = lambda i: F.regexp_extract(label, ITEM_LONG, i)
    short_part = lambda i: F.regexp_extract(label, ITEM_SHORT, i)
    return {
        "ok": is_long | is_short,
        "dns": F.when(is_long, long_part(1)).otherwise(short_part(1)),
        "item": F.when(is_long, long_part(2)).otherwise(short_part(2)),
        "colour": long_part(3),
        "size": size(long_part(4)),
    }
