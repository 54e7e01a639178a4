"""File names are binary from end to end, so names in any encoding survive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def strip_directory(path: Column, directory: bytes) -> Column:
    """Name of a path below ``directory``; fails on a path that is not below it."""
    prefix = directory if directory.endswith(b"/") else directory + b"/"
    inside = F.startswith(path, F.lit(prefix))
    problem = F.concat(F.lit("path is not below the directory: "), path.cast("string"))
    return F.when(inside, F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(
        F.raise_error(problem).cast("binary")
    )


def strip_root(name: Column) -> Column:
    """Drop one leading ``./`` or ``/``."""
    return (
        F.when(F.startswith(name, F.lit(b"./")), F.substring(name, 3, 2**31 - 1))
        .when(F.startswith(name, F.lit(b"/")), F.substring(name, 2, 2**31 - 1))
        .otherwise(name)
    )


def manifest_record(hash_: Column, filename: Column) -> Column:
    """One manifest line without its NUL terminator."""
    return F.concat(hash_, F.lit(" "), filename.cast("string"))


def record_is_short(record: Column) -> Column:
    return F.octet_length(record) < fv.MIN_RECORD_BYTES
