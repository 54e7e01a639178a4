"""Object keys of uploaded snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import utc_iso


def _stem(volume_id: Column, start_time: Column, snapshot_id: Column, description: Column) -> Column:
    return F.concat(
        volume_id,
        F.lit("/"),
        utc_iso(start_time),
        F.lit(" "),
        snapshot_id,
        F.when(F.length(description) > 0, F.concat(F.lit(" - "), description)).otherwise(F.lit("")),
    )


def image_base(volume_id: Column, start_time: Column, snapshot_id: Column, description: Column) -> Column:
    """Key of a whole-volume image without codec and encryption endings."""
    return F.concat(_stem(volume_id, start_time, snapshot_id, description), F.lit(fv.IMAGE_SUFFIX))


def archive_base(
    volume_id: Column, start_time: Column, snapshot_id: Column, description: Column, partition: Column
) -> Column:
    """Key of one partition's archive without codec and encryption endings."""
    part = F.when(F.length(partition) > 0, F.concat(F.lit("."), partition)).otherwise(F.lit(""))
    return F.concat(_stem(volume_id, start_time, snapshot_id, description), part, F.lit(fv.ARCHIVE_SUFFIX))


def full_key(base: Column, codec: Column, encrypted: Column) -> Column:
    return F.concat(
        base, F.lit("."), codec, F.when(encrypted, F.lit(fv.ENCRYPTED_SUFFIX)).otherwise(F.lit(""))
    )


def _unencrypted(key: Column) -> Column:
    shorter = F.substring(key, F.lit(1), F.length(key) - len(fv.ENCRYPTED_SUFFIX))
    return F.when(key_encrypted(key), shorter).otherwise(key)


def key_base(key: Column) -> Column:
    """``key`` without its codec and encryption endings; empty if it has no codec."""
    bare = _unencrypted(key)
    return F.coalesce(
        *[F.when(bare.endswith(f".{c}"), F.substring(bare, F.lit(1), F.length(bare) - len(c) - 1)) for c in fv.CODECS],
        F.when(key.isNotNull(), F.lit("")),
    )


def key_codec(key: Column) -> Column:
    """The codec ending of ``key``, empty if it has none."""
    bare = _unencrypted(key)
    return F.coalesce(*[F.when(bare.endswith(f".{c}"), F.lit(c)) for c in fv.CODECS], F.when(key.isNotNull(), F.lit("")))


def key_encrypted(key: Column) -> Column:
    return key.endswith(fv.ENCRYPTED_SUFFIX)
