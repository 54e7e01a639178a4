"""Near-duplicate texts by MinHash with tensored banding.

Two small collections of sketches are drawn for each text, each sketch made of a few minhashes.
A table is a pair of sketches, one of each collection: with 10 + 10 sketches of three minhashes
there are 100 tables of six minhashes from 60 minhashes instead of 600. Texts that share a table
key are candidates, and all links are confirmed on the full shingle sets.

Only connected groups are asked for, so no bucket is expanded into all its pairs at first: each
text is compared with the bucket leader it meets most often. Buckets that are not connected then
form families. A family of more than a tile of texts is narrowed first: texts of it can only be
linked if the rarest shingles of the one, by their number in the family, meet those of the other,
so texts that share no more than a template fall apart. What is left is dealt into tiles of a
bounded number of texts, and each pair of tiles is compared in full by one product of matrices.
No row is made for a pair of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, ship_package
from .arrays import batchwise, byte_view, free_name, slices
from .components import connected_components, least_of_components
from .embedding_dedup import forest
from .shingles import fingerprint, intersection_size, mixed, shingle_sets

#: Words of a shingle, and the least similarity in percent.
WORDS = 5
LEAST_PERCENT = 80
#: Sketches of a collection, and minhashes of a sketch. Of pairs at the least similarity,
#: (1 - (1 - 0.8^3)^10)^2 = 99.8 % share a table key.
SKETCHES = 10
SKETCH_HASHES = 3
#: Rounds in which every text is compared with one leader before the rest is compared in full.
LEADER_ROUNDS = 2
#: Texts of a tile, on average.
TILE_TEXTS = 128
_FACTORS = np.random.default_rng(20240518).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketches(shingles: np.ndarray, offsets: np.ndarray, sketches: int, hashes: int) -> list[np.ndarray]:
    """For both collections, sketches of each text with shingles: rows of ``sketches`` 64-bit numbers."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    found = []
    for collection in range(2):
        made = np.empty((len(starts), sketches), np.uint64)
        for sketch in range(sketches):
            value = np.full(len(starts), collection * sketches + sketch + 1, np.uint64)
            for h in range(hashes):
                factor = _FACTORS[((collection * sketches + sketch) * hashes + h) % len(_FACTORS)]
                least = np.minimum.reduceat(shingles * factor, starts) if len(starts) else starts.astype(np.uint64)
                value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + least)
            made[:, sketch] = value
        found.append(made)
    return found


def _signed(batches: Iterator[pa.RecordBatch], words: int, sketches: int, hashes: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            shingles, offsets = shingle_sets(*byte_view(batch.column("text")), words)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            marks: list[bytes | None] = [None] * batch.num_rows
            for i in full.tolist():
                marks[i] = fingerprint(shingles[offsets[i] : offsets[i + 1]])
            columns = [batch.column("doc_id"), pa.array(sizes), pa.array(marks, pa.binary())]
            for made in _sketches(shingles, offsets, sketches, hashes):
                lists = np.zeros(batch.num_rows + 1, np.int32)
                lists[1:] = np.cumsum(sizes > 0) * sketches
                columns.append(pa.ListArray.from_arrays(pa.array(lists), pa.array(made.view(np.int64).ravel())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "mark", "left", "right"])


def _with_mark(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the shingle set that ``mark`` stands for."""
    for whole in batches:
        for batch in slices(whole, "text"):
            shingles, offsets = shingle_sets(*byte_view(batch.column("text")), words)
            marks = batch.column("mark").to_pylist()
            same = [fingerprint(shingles[offsets[i] : offsets[i + 1]]) == mark for i, mark in enumerate(marks)]
            yield batch.filter(pa.array(same, pa.bool_()))


def _confirmed(batches: Iterator[pa.RecordBatch], words: int, least_percent: int) -> Iterator[pa.RecordBatch]:
    known, leader = None, None
    for whole in batches:
        for batch in slices(whole, "text_b"):
            sets, offsets = shingle_sets(*byte_view(batch.column("text_b")), words)
            leaders = batch.column("a").to_pylist()
            texts = batch.column("text_a")
            linked = np.zeros(batch.num_rows, bool)
            for i, its_leader in enumerate(leaders):
                if its_leader != leader:
                    known = shingle_sets(*byte_view(texts.slice(i, 1)), words)[0]
                    leader = its_leader
                own = sets[offsets[i] : offsets[i + 1]]
                common = intersection_size(known, own)
                linked[i] = 100 * common >= least_percent * (len(known) + len(own) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"]
            )


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, least_percent: int) -> DataFrame:
    """``pairs`` (a, b) and whether they are linked, by the full sets of their texts, staged.

    The text of b, which differs from pair to pair, moves first; the text of a leader is met last.
    """
    text_b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge")
    text_a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge")
    joined = pairs.join(text_b, "b").join(text_a, "a").select("a", "b", "text_a", "text_b")
    return durable(
        joined.transform(
            batchwise,
            lambda batches: _confirmed(batches, words, least_percent), "a bigint, b bigint, linked boolean"
        )
    )


def _sizes_allow(one: Column, other: Column, least_percent: int) -> Column:
    return F.least(one, other) * 100 >= F.greatest(one, other) * least_percent


def _shared(classes: DataFrame, side: str) -> DataFrame:
    """Ids of the classes that share a sketch of one collection with another class."""
    sketches = classes.select("id", F.explode(side).alias("key"))
    common = sketches.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    return sketches.join(common, "key").select("id").distinct()


def candidate_members(classes: DataFrame) -> DataFrame:
    """key, id and n_shingles of the classes in every table bucket that has several, staged.

    Classes that share no sketch of the one or of the other collection share no table key, so they
    are left out before the tables are formed.
    """
    near = classes.join(_shared(classes, "left"), "id", "left_semi").join(_shared(classes, "right"), "id", "left_semi")
    near = durable(near.select("id", "n_shingles", "left", "right"))
    keys = durable(
        near.select("id", "n_shingles", "right", F.explode("left").alias("one"))
        .select("id", "n_shingles", "one", F.explode("right").alias("other"))
        .select("id", "n_shingles", F.xxhash64("one", "other").alias("key"))
    )
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    return durable(keys.join(buckets, "key").select("key", "id", "n_shingles"))


def _placed(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """``members`` with the component that ``links`` so far put them into."""
    if not links:
        return members.withColumn("component", F.col("id"))
    edges = reduce(DataFrame.unionByName, links).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    tied = connected_components(edges)
    return members.join(tied.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )


def _open_buckets(placed: DataFrame) -> DataFrame:
    """The members of buckets in which not all are connected yet, with the bucket's lowest component."""
    buckets = (
        placed.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("leader"))
        .where("low < high")
    )
    return placed.join(buckets.select("key", "low", "leader"), "key")


def _leader_pairs(placed: DataFrame, tested: list[DataFrame], least_percent: int) -> DataFrame:
    """For each member not connected with the lowest component of a bucket, the one leader of that
    component that it meets in most buckets."""
    opened = _open_buckets(placed)
    heads = (
        opened.where("component = low")
        .groupBy("key")
        .agg(F.min_by(F.struct("id", "n_shingles"), F.xxhash64("id", F.lit(len(tested)))).alias("head"))
    )
    others = opened.where("component > low").select("key", "id", "n_shingles")
    met = (
        others.join(heads, "key")
        .where(_sizes_allow(F.col("n_shingles"), F.col("head.n_shingles"), least_percent))
        .select(F.col("head.id").alias("a"), F.col("id").alias("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    for old in tested:
        met = met.join(old.select("a", "b"), ["a", "b"], "left_anti")
    return met.groupBy("b").agg(F.max_by("a", F.col("votes")).alias("a")).select("a", "b")


def _tile_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts, the text of each, and the sizes of the sets."""
    shingles, offsets = shingle_sets(*byte_view(texts), words)
    sizes = np.diff(offsets)
    return shingles, np.repeat(np.arange(len(sizes)), sizes), sizes


def _tile_links(a: pa.RecordBatch, b: pa.RecordBatch, words: int, least_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of linked texts of two tiles (or of one, twice) that are not connected yet."""
    values_a, owner_a, size_a = _tile_sets(a.column("text"), words)
    values_b, owner_b, size_b = (values_a, owner_a, size_a) if a is b else _tile_sets(b.column("text"), words)
    group_a, group_b = a.column("component").to_numpy(), b.column("component").to_numpy()
    apart = group_a[:, None] != group_b[None, :]
    if not apart.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Only shingles of both tiles count; a column of the matrices stands for one of them.
    common = np.intersect1d(values_a, values_b)
    sides = []
    for values, owner, count in ((values_a, owner_a, len(size_a)), (values_b, owner_b, len(size_b))):
        place = np.searchsorted(common, values)
        found = place < len(common)
        found[found] = common[place[found]] == values[found]
        sides.append((place[found], owner[found], count))
    both = np.zeros((len(size_a), len(size_b)))
    for start in range(0, len(common), _COLUMNS):
        parts = []
        for place, owner, count in sides:
            inside = (place >= start) & (place < start + _COLUMNS)
            part = np.zeros((count, min(_COLUMNS, len(common) - start)), np.float32)
            part[owner[inside], place[inside] - start] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    union = size_a[:, None] + size_b[None, :] - both
    i, j = np.nonzero(apart & (100 * both >= least_percent * union))
    return a.column("id").to_numpy()[i], b.column("id").to_numpy()[j]


#: Columns of the matrices at a time; sums of ones below 2 ** 24 are exact in them.
_COLUMNS = 1 << 14


def _compared_tiles(batches: Iterator[pa.RecordBatch], words: int, least_percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each pair of tiles; the rows of a pair follow one another, side by side."""
    pair, sides = None, ([], [])

    def finish() -> pa.RecordBatch:
        tiles = [pa.Table.from_batches(held).combine_chunks().to_batches()[0] for held in sides if held]
        # A pair of different tiles of which one has no texts has nothing to compare.
        a, b = _tile_links(tiles[0], tiles[-1], words, least_percent) if len(tiles) == 2 or pair[1] == pair[2] else ([], [])
        if len(a):
            a, b = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for whole in batches:
        for batch in slices(whole, "text"):
            keys = list(zip(*(batch.column(name).to_pylist() for name in ("family", "first", "second"))))
            side = batch.column("side").to_numpy()
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start] or side[i] != side[start]:
                    if keys[start] != pair and pair is not None:
                        yield finish()
                        sides = ([], [])
                    pair = keys[start]
                    sides[side[start]].append(batch.slice(start, i - start).select(["id", "component", "text"]))
                    start = i
    if pair is not None:
        yield finish()


def _shingle_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each text."""
    for whole in batches:
        for batch in slices(whole, "text"):
            shingles, offsets = shingle_sets(*byte_view(batch.column("text")), words)
            sizes = np.diff(offsets)
            owners = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            names = ["family", "component", "id"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(name).take(owners) for name in names],
                    pa.array(np.repeat(sizes, sizes)),
                    pa.array(shingles.view(np.int64)),
                ],
                [*names, "size", "shingle"],
            )


def _narrowed(members: DataFrame, texts: DataFrame, words: int, least_percent: int) -> DataFrame:
    """``members`` (id, component, family) that may be linked with others not connected yet, in smaller families.

    Put the shingles of every text in one order, rare ones of the family first. Let y have no more
    shingles than x. If they are linked, they have at least t |x| shingles in common, and at least
    2 t / (1 + t) |y|; so one of the first |y| - 2 t / (1 + t) |y| + 1 of y is among the first
    |x| - t |x| + 1 of x. Texts that meet like this, directly or through others, stay together.
    """
    keys = ["family", "shingle"]
    rows = durable(
        members.join(texts.hint("merge"), "id")
        .select("family", "component", "id", "text")
        .transform(
            batchwise,
            lambda batches: _shingle_rows(batches, words),
            "family bigint, component bigint, id bigint, size bigint, shingle bigint",
        )
    )
    shared = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("held_by")).where("held_by > 1")
    held = rows.join(shared, keys)
    of_text = Window.partitionBy("id")
    # The shingles that no other text of the family has come first, and are not among these rows.
    rank = F.row_number().over(of_text.orderBy("held_by", "shingle")) + F.col("size") - F.count(F.lit(1)).over(of_text)
    size, percent = F.col("size"), F.lit(least_percent)
    longest = size - F.ceil(size * percent / 100) + 1
    short = size - F.ceil(size * 2 * percent / (100 + percent)) + 1
    firsts = durable(
        held.withColumn("rank", rank)
        .where(F.col("rank") <= longest)
        .select(*keys, "component", "id", (F.col("rank") <= short).alias("leads"))
    )
    met = (
        firsts.groupBy(*keys)
        .agg(
            F.min("id").alias("first"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.bool_or("leads").alias("led"),
        )
        .where("low < high AND led")
    )
    edges = firsts.join(met, keys).select(F.col("id").alias("u"), F.col("first").alias("v"))
    tied = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("family"))
    lowest = tied.select(F.col("family").alias("id"), "family").distinct()
    return members.select("id", "component").join(tied.unionByName(lowest), "id")


def _family_links(placed: DataFrame, texts: DataFrame, words: int, least_percent: int) -> DataFrame:
    """a, b and linked (always true): links that connect all linked texts of buckets not connected so far.

    Buckets that share texts are one family, narrowed where it is larger than a tile. Its texts are
    dealt by hash into tiles; a task compares two tiles, so a family of any size is spread over many
    tasks.
    """
    opened = durable(_open_buckets(placed).select("id", "component", "leader").distinct())
    families = connected_components(opened.select(F.col("id").alias("u"), F.col("leader").alias("v")))
    members = durable(
        opened.select("id", "component")
        .distinct()
        .join(families.select(F.col("node").alias("id"), F.col("component").alias("family")), "id", "left")
        .withColumn("family", F.coalesce("family", "id"))
    )
    sizes = durable(members.groupBy("family").agg(F.count(F.lit(1)).alias("texts")))
    large = sizes.where(F.col("texts") > TILE_TEXTS)
    if not large.isEmpty():
        few = members.join(large, "family", "left_anti")
        narrowed = _narrowed(members.join(large, "family", "left_semi"), texts, words, least_percent)
        members = durable(few.unionByName(narrowed))
        sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("texts"))
    counts = sizes.select("family", F.ceil(F.col("texts") / TILE_TEXTS).cast("int").alias("tiles"))
    tile, other = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"), F.col("other")
    dealt = (
        members.join(counts, "family")
        .join(texts.hint("merge"), "id")
        .withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "family",
            F.least("tile", other).alias("first"),
            F.greatest("tile", other).alias("second"),
            (F.col("tile") > other).cast("int").alias("side"),
            "id",
            "component",
            "text",
        )
    )
    return durable(
        dealt.repartition("family", "first", "second")
        .sortWithinPartitions("family", "first", "second", "side")
        .transform(batchwise, lambda batches: _compared_tiles(batches, words, least_percent), "a bigint, b bigint")
        .withColumn("linked", F.lit(True))
    )


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    least_percent: int = LEAST_PERCENT,
    sketches: int = SKETCHES,
    sketch_hashes: int = SKETCH_HASHES,
    leader_rounds: int = LEADER_ROUNDS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs``.

    Texts are linked when 100 * intersection >= ``least_percent`` * union of their shingle sets.
    A text with fewer words than a shingle has one shingle, all its words. Null and empty texts and
    those without words have none and are linked with nothing. A null id is its own group. Rows that
    share an id are linked by their own texts, equal rows with each other. Texts of any length are taken
    whole. An empty table gives an empty result; further columns do not matter, whatever their names.
    """
    ship_package(docs.sparkSession)
    source = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    signed = durable(
        source.transform(
            batchwise,
            lambda batches: _signed(batches, words, sketches, sketch_hashes),
            "doc_id bigint, n_shingles bigint, mark binary, left array<bigint>, right array<bigint>",
        )
    )
    # Texts with equal sets are one class, whatever its size. It has a number of its own, as rows that
    # share an id may differ in their texts.
    classes = durable(
        signed.where("mark IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("mark")
        .agg(
            F.min("doc_id").alias("least"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("left").alias("left"),
            F.first("right").alias("right"),
        )
        .withColumn("id", F.monotonically_increasing_id())
    )
    members = candidate_members(classes.select("id", "n_shingles", "left", "right"))
    wanted = members.select("id").distinct().join(classes.select("id", "least", "mark"), "id")
    texts = durable(
        source.join(wanted, source["doc_id"] == wanted["least"])
        .select("id", "mark", "text")
        .transform(batchwise, lambda batches: _with_mark(batches, words), "id bigint, mark binary, text string")
        .select("id", "text")
        .dropDuplicates(["id"])
    )
    tested: list[DataFrame] = []
    for _ in range(leader_rounds):
        placed = durable(_placed(members, tested))
        tested.append(confirmed(_leader_pairs(placed, tested, least_percent), texts, words, least_percent))
    tested.append(_family_links(durable(_placed(members, tested)), texts, words, least_percent))
    edges = reduce(DataFrame.unionByName, tested).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    reached = least_of_components(classes.select(F.col("id").alias("node"), "least"), edges)
    grouped = classes.join(reached, classes["id"] == reached["node"]).select(
        classes["mark"].alias("of_mark"), F.col("reached").alias("component")
    )
    joined = signed.select("doc_id", "n_shingles", "mark").join(
        grouped, (F.col("mark") == F.col("of_mark")) & F.col("doc_id").isNotNull(), "left"
    )
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    Rows are numbered in a staged copy, so the numbers stay the same whatever happens to the cluster;
    rows that share an id are told apart.
    """
    number = free_name(docs, "row_number")
    numbered = durable(docs.withColumn(number, F.monotonically_increasing_id()))
    plain = numbered.select(F.col(number).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dropped = near_groups(plain, **options).where(~F.col("kept")).select(F.col("doc_id").alias(number))
    return numbered.join(dropped, number, "left_anti").select(*[f"`{name}`" for name in docs.columns])
