"""Exact dedup by content-defined chunk recipes.

Texts are cut into content-defined chunks. A chunk gets an identifier, which is verified to
stand for one byte string only. A text is then the ordered list of its identifiers (its
recipe), and texts are equal when their recipes are. Each distinct chunk is moved once, to be
verified; the texts themselves are never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, ship_package
from .arrays import batchwise, byte_view, free_name, slices
from .chunking import chunk_ends

#: Bytes of an identifier at first.
DIGEST_BYTES = 16
#: A chunk has 2 ** CHUNK_BITS bytes on average.
CHUNK_BITS = 10
_MOST_DIGEST_BYTES = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cut(batch: pa.RecordBatch, digest_bytes: int, chunk_bits: int) -> tuple[bytes, np.ndarray, np.ndarray, list, np.ndarray]:
    """Lower-cased bytes of the batch, text offsets, chunk begins and digests, and texts' first chunks."""
    data, offsets = byte_view(batch.column("text"))
    data = _LOWER[data]
    ends, owners = chunk_ends(data, offsets, chunk_bits)
    raw = data.tobytes()
    borders = np.concatenate([[0], ends]).astype(np.int64)
    digests = [
        hashlib.blake2b(raw[a:b], digest_size=digest_bytes).digest()
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())
    ]
    firsts = np.searchsorted(owners, np.arange(batch.num_rows + 1))
    return raw, offsets, borders, digests, firsts


def _recipes(batches: Iterator[pa.RecordBatch], digest_bytes: int, chunk_bits: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, offsets, _, digests, firsts = _cut(batch, digest_bytes, chunk_bits)
            places, first = offsets.tolist(), firsts.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([b"".join(digests[a:b]) for a, b in zip(first, first[1:])], pa.binary()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(places, places[1:])], pa.string()),
                    batch.column("kept_columns"),
                ],
                ["row", "recipe", "text_sha256", "kept_columns"],
            )


def _chunks(batches: Iterator[pa.RecordBatch], digest_bytes: int, chunk_bits: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, _, borders, digests, _ = _cut(batch, digest_bytes, chunk_bits)
            # Repeats within the slice are dropped before anything is moved.
            found = {(d, raw[a:b]) for d, a, b in zip(digests, borders[:-1].tolist(), borders[1:].tolist())}
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())],
                ["digest", "chunk"],
            )


def verified_recipes(
    docs: DataFrame, text: str = "text", digest_bytes: int = DIGEST_BYTES, chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """``row`` (a number), ``recipe``, ``text_sha256`` and ``kept_columns`` (a struct of all columns
    but the text) of each row, staged.

    All chunks with one identifier are compared byte for byte. If two differ, identifiers of twice
    the length are taken and verified in turn.
    """
    ship_package(docs.sparkSession)
    others = [docs[f"`{name}`"] for name in docs.columns if name != text]
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.struct(F.lit(0).alias("_"), *others).alias("kept_columns"),
    )
    kept_type = source.schema["kept_columns"].dataType.simpleString()
    while True:
        size = digest_bytes
        chunks = source.select("text").transform(
            batchwise,
            lambda batches: _chunks(batches, size, chunk_bits), "digest binary, chunk binary"
        )
        clashes = (
            chunks.groupBy("digest").agg(F.count_distinct("chunk").alias("contents")).where("contents > 1").count()
        )
        if not clashes:
            break
        if digest_bytes >= _MOST_DIGEST_BYTES:
            raise ValueError("chunks differ that have equal identifiers of the greatest length")
        digest_bytes *= 2
    return durable(
        source.transform(
            batchwise,
            lambda batches: _recipes(batches, size, chunk_bits),
            f"row bigint, recipe binary, text_sha256 string, kept_columns {kept_type}",
        )
    )


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    digest_bytes: int = DIGEST_BYTES,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """One row per row of ``docs``: keep_id, group_size, kept and text_sha256, besides ``kept_columns``.

    Texts are equal when they are identical after lower-casing A-Z; null and empty texts are
    equal. Of equal texts the row with the largest id stays; an id that is null is the smallest,
    and of several rows with the largest id exactly one stays. An empty table gives an empty result.
    """
    recipes = verified_recipes(docs, text, digest_bytes, chunk_bits).withColumn(
        "id", F.col(f"kept_columns.`{doc_id}`").cast("long")
    )
    rank = F.coalesce("id", F.lit(-(2**63)))
    groups = durable(
        recipes.groupBy("recipe")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max("id").alias("keep_id"),
            F.max_by("row", rank).alias("keep_row"),
        )
        .where("group_size > 1")
    )
    joined = recipes.join(groups, "recipe", "left")
    return joined.select(
        "row",
        "kept_columns",
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def exact_dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The decision on each document: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(docs, doc_id, text).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are numbered in a staged copy, so the numbers stay the same whatever happens to the cluster.
    """
    number = free_name(docs, "row_number")
    numbered = durable(docs.withColumn(number, F.monotonically_increasing_id()))
    dropped = durable(
        exact_groups(numbered, doc_id, text)
        .where(~F.col("kept"))
        .select(F.col(f"kept_columns.{number}").alias(number))
    )
    return numbered.join(dropped, number, "left_anti").select(*[f"`{name}`" for name in docs.columns])
