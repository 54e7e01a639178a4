"""Composite sort keys that stay fixed-width."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 10**19
_LAST = 2**63 - 1


def order_key(major: Column, minor: Column, *, minor_descending: bool = False) -> Column:
    """One decimal that sorts as ``(major, minor)``; ``minor`` must not be negative.

    ``min_by`` and ``max_by`` over a struct have to sort the whole input before
    aggregating it; over a decimal they stay hash aggregates with codegen.
    """
    if minor_descending:
        minor = F.lit(_LAST) - minor
    return major.cast("decimal(19,0)") * F.lit(Decimal(_SPAN)) + minor.cast("decimal(19,0)")
