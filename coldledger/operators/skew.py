"""Joins and numbering that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, ship_package

# A key is split when it holds more than 1/HOT_SHARE of all rows, or the rows of more than
# HOT_PARTS parts. So n rows have at most HOT_SHARE + n / (HOT_PARTS * PART_ROWS) such keys, which
# bounds what is broadcast here: 21,000 keys of 10^12 rows.
HOT_SHARE = 1000
HOT_PARTS = 50
# Rows of one part of a split key, at most.
PART_ROWS = 1_000_000
# Copies of a row that are written in one piece.
COPIES = 4096
_ROW_BITS = 33


def parts_per_key(rows_per_key: DataFrame, keys: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """The hot keys of ``rows_per_key`` and into how many parts each is split."""
    total = rows_per_key.agg(F.sum("rows").alias("total")).scalar()
    most = F.greatest(F.least(F.lit(part_rows), F.floor(total / HOT_SHARE)), F.lit(1))
    hot = (F.col("rows") * HOT_SHARE > total) | (F.col("rows") > HOT_PARTS * part_rows)
    return rows_per_key.where(hot).select(
        *keys, F.ceil(F.col("rows") / most).cast("int").alias("_parts")
    )


def _spread(
    facts: DataFrame, dims: DataFrame, keys: list[str], rows_per_key: DataFrame, spread_by: str, how: str, part_rows: int
) -> DataFrame:
    """Join with every hot key split into as many parts as its rows ask for."""
    hot = F.broadcast(parts_per_key(rows_per_key, keys, part_rows))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salt = F.pmod(F.xxhash64(F.col(spread_by)), parts).cast("int")
    salted_facts = facts.join(hot, keys, "left").withColumn("_salt", salt).drop("_parts")
    salted_dims = dims.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted_facts.join(salted_dims, [*keys, "_salt"], how).drop("_salt")


def join_spread(
    facts: DataFrame,
    dims: DataFrame,
    keys: Sequence[str],
    rows_per_key: DataFrame,
    spread_by: str,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Left join of ``facts`` with ``dims`` (unique per key), splitting hot keys.

    ``rows_per_key`` holds the keys and a ``rows`` count of ``facts``. A key with
    more than a thousandth of all rows, or more than HOT_PARTS times ``part_rows``,
    is split by a hash of ``spread_by`` into parts of at most ``part_rows`` rows and
    at most a thousandth of all, on average; its one dimension row is repeated for
    each. Other keys are untouched.
    """
    return _spread(facts, dims, list(keys), rows_per_key, spread_by, "left", part_rows)


def semi_join_spread(
    facts: DataFrame, wanted: DataFrame, keys: Sequence[str], spread_by: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """``facts`` whose key is in ``wanted``, whose keys are distinct.

    ``wanted`` has the keys and ``rows``, how many of ``facts`` each has. Hot keys
    are split as in ``join_spread``; only these are repeated, by their own counts.
    """
    keys = list(keys)
    counted = wanted.select(*keys, "rows")
    return _spread(facts, counted.select(*keys), keys, counted, spread_by, "left_semi", part_rows).select(*facts.columns)


def with_rows(wanted: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``wanted`` keys that ``facts`` has, with their number of ``rows`` there."""
    return wanted.join(facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), list(keys))


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Sort ``df`` globally and number its rows from 1.

    ``df`` is computed once: a sort samples its input before it reads it, so it is given a staged
    one. The sorted rows are staged together with the number of their partition and their place in
    it. A row's number is that place plus the sizes of the partitions before; only those sizes (one
    row per partition) meet in one task.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**_ROW_BITS - 1)) + 1
    ranked = durable(durable(df).orderBy(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_end")))
    return _after_bases(ranked).select((F.col("_base") + F.col("_end")).alias(name), *df.columns)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by a hash of ``keys`` to as many tasks as shuffles have.

    For rows that are few now and written out to many next: their size says nothing, so adaptive
    execution must not bring them together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _after_bases(ranked: DataFrame) -> DataFrame:
    """``ranked`` with ``_base``, the sum of the greatest ``_end`` of all partitions before a row's own."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranked.groupBy("_part")
        .agg(F.max("_end").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    )
    return ranked.join(F.broadcast(bases), "_part")


def _running(batches: Iterator[pa.RecordBatch], weight: str) -> Iterator[pa.RecordBatch]:
    """Each row of a partition with the sum of ``weight`` up to and with it."""
    total = 0
    for batch in batches:
        ends = total + np.cumsum(batch.column(weight).to_numpy())
        total = int(ends[-1]) if len(ends) else total
        yield batch.append_column("_end", pa.array(ends, pa.int64()))


def _with_ends(df: DataFrame, weight: str) -> DataFrame:
    """``df``, staged, with its partition (``_part``) and the sum of ``weight`` in it so far (``_end``)."""
    ship_package(df.sparkSession)
    placed = df.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*placed.schema.fields, T.StructField("_end", T.LongType())])
    return durable(placed.mapInArrow(lambda batches: _running(batches, weight), schema))


def dealt_by_weight(df: DataFrame, weight: Column, tasks: int) -> DataFrame:
    """``df`` cut into ``tasks`` partitions of like sums of ``weight``, a positive whole number.

    A row's place on the line of all weights, by a prefix sum over partitions, says which partition
    it goes to; a row heavier than a partition's share has one to itself or with few others.
    """
    placed = _with_ends(df.withColumn("_weight", weight.cast("bigint")), "_weight")
    total = placed.agg(F.sum("_weight")).first()[0] or 1
    middle = F.col("_base") + F.col("_end") - F.col("_weight") / 2
    share = F.least(F.floor(middle * tasks / total), F.lit(tasks - 1)).cast("int")
    return _after_bases(placed).withColumn("_share", share).repartitionById(tasks, "_share").select(*df.columns)


def sort_with_copies(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Sort ``df`` globally by ``order``, which covers all its columns, and number its rows from 1.

    Equal rows are counted first, so only different ones are sorted, and each takes as many numbers
    as it has copies. Up to COPIES copies are written where the row was sorted to; more are dealt to
    all tasks in pieces of that size.
    """
    columns = df.columns
    runs = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    placed = _after_bases(_with_ends(durable(runs).orderBy(*order), "_copies"))
    numbered = placed.select(*columns, "_copies", (F.col("_base") + F.col("_end") - F.col("_copies")).alias("_start"))
    few = numbered.where(F.col("_copies") <= COPIES).select(*columns, "_start", "_copies")
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(COPIES).cast("bigint")))
    many = (
        numbered.where(F.col("_copies") > COPIES)
        .withColumn("_first", first)
        .select(
            *columns,
            (F.col("_start") + F.col("_first")).alias("_start"),
            F.least(F.col("_copies") - F.col("_first"), F.lit(COPIES).cast("bigint")).alias("_copies"),
        )
        .transform(dealt, "_start")
    )
    numbers = F.explode(F.sequence(F.col("_start") + 1, F.col("_start") + F.col("_copies")))
    return few.unionByName(many).select(numbers.alias(name), *columns)
