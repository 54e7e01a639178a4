"""Tags are ``array<struct<Key:string,Value:string>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def tag_value(tags: Column, key: str) -> Column:
    """Value of the first tag with that key, else null."""
    return F.try_element_at(F.filter(tags, lambda t: t["Key"] == key), F.lit(1))["Value"]


def has_tag(tags: Column, key: str, value: str | None = None) -> Column:
    if value is None:
        return F.coalesce(F.exists(tags, lambda t: t["Key"] == key), F.lit(False))
    matches = F.exists(tags, lambda t: (t["Key"] == key) & (t["Value"] == value))
    return F.coalesce(matches, F.lit(False))


def legal_text(text: Column) -> Column:
    """Replace characters an object tag may not hold, then cut to the length limit."""
    narrow = F.regexp_replace(text, fv.WIDE_CHARACTER, "__")
    return F.substring(F.regexp_replace(narrow, fv.ILLEGAL_TAG_CHARACTER, "_"), 1, fv.TAG_LIMIT)


def sanitise_tags(tags: Column, own_tag: str) -> Column:
    """Drop our own and reserved tags; make the others legal."""
    kept = F.filter(
        tags,
        lambda t: ~t["Key"].isin(own_tag, own_tag + "-id") & ~t["Key"].startswith(fv.RESERVED_TAG_PREFIX),
    )
    return F.transform(
        kept,
        lambda t: F.struct(legal_text(t["Key"]).alias("Key"), legal_text(t["Value"]).alias("Value")),
    )


def volume_name(tags: Column) -> Column:
    """Name tag, or an empty string without one."""
    return F.coalesce(tag_value(tags, fv.NAME_TAG), F.lit(""))
