"""Mix sources to target weights.

The words of each source are packed, document after document, into blocks of fixed length. The
mix is a sequence of slots in output shards; each shard draws how many slots each source gets
from a multinomial distribution. A source's slots are mapped through a pseudorandom permutation
of its block numbers, a new one for each pass over the source, and joined with the blocks by
number.

Nothing here grows with the number of sources but tables: sources are numbered by a distributed
sort, their targets follow from one water level, and the slots of the shards are drawn down a tree
of sources, FANOUT children a node, one level after another.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.skew import dealt, join_spread, with_positions
from ..session import durable, ship_package
from .arrays import batchwise, free_name, slices

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times at most.
MOST_PASSES = 3
BLOCK_WORDS = 1024
#: Output shards have LEAST_SHARD_SLOTS slots, or more so that there are MOST_SHARDS shards at most.
LEAST_SHARD_SLOTS = 1024
MOST_SHARDS = 4096
#: Children of a node of the tree of sources. A task draws for one node at a time, so it holds at
#: most MOST_SHARDS x FANOUT counts.
FANOUT = 256
#: Wordless documents have block numbers below 0, of which there are this many.
_NO_BLOCKS = 1 << 20
#: Rows that a window over one bucket of a source numbers, on average.
BUCKET_ROWS = 4096
SEED = 20240817
_WORD = r"[^\x20\x09-\x0D]+"
_ROUNDS = 4


def target_words(sizes: Sequence[int], weights: Sequence[float], most_passes: int = MOST_PASSES) -> list[float]:
    """Words to take of each source: the sum of all sizes shared by weight, where no source gets
    more than ``most_passes`` times its size and the excess is shared again by weight. For sizes at
    hand; ``with_targets`` does the same for a table of sources."""
    targets = [0.0] * len(sizes)
    left, free = float(sum(sizes)), [i for i, size in enumerate(sizes) if size > 0]
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= most_passes * sizes[i]]
        if not full:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(most_passes * sizes[i])
        left -= sum(targets[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return targets


@dataclass(frozen=True)
class Permutation:
    """A pseudorandom permutation of 0 .. size - 1: a Feistel network whose outputs are walked
    until they fall into the range."""

    size: int
    seed: int

    def _half_bits(self) -> int:
        return max(1, math.ceil(max(1, (self.size - 1).bit_length()) / 2))

    def _mixed(self, half: np.ndarray, turn: int, bits: int) -> np.ndarray:
        key = np.uint64((self.seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
        x = (half + key) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return (x ^ (x >> np.uint64(29))) & np.uint64((1 << bits) - 1)

    def _walk(self, values: np.ndarray, turns: Sequence[int], back: bool) -> np.ndarray:
        if self.size == 1:
            return np.zeros(len(values), np.int64)
        bits = self._half_bits()
        low = np.uint64((1 << bits) - 1)
        out = np.asarray(values, np.uint64).copy()
        todo = np.arange(len(out))
        while len(todo):
            x = out[todo]
            left, right = x >> np.uint64(bits), x & low
            for turn in turns:
                if back:
                    left, right = right ^ self._mixed(left, turn, bits), left
                else:
                    left, right = right, left ^ self._mixed(right, turn, bits)
            out[todo] = (left << np.uint64(bits)) | right
            todo = todo[out[todo] >= self.size]
        return out.astype(np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, range(_ROUNDS), back=False)

    def place_of(self, value: int) -> int:
        return int(self._walk(np.array([value]), range(_ROUNDS - 1, -1, -1), back=True)[0])


def _permutation(source: int, turn: int, blocks: int, seed: int) -> Permutation:
    return Permutation(blocks, (seed * 1_000_003 + source) * 1009 + turn)


def with_targets(sources: DataFrame, weights: Sequence[float], most_passes: int = MOST_PASSES) -> DataFrame:
    """``sources`` (source_no, size) with target: what ``target_words`` gives, for any number of sources.

    A source gets its weight times a water level, or ``most_passes`` times its size if that is less.
    The level rises while sources fill up: each round is one aggregate over the sources, with one
    row per weight, and the last is the first round in which no further source is full.
    """
    kind = F.pmod("source_no", F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (kind + 1).cast("int"))
    most = (F.col("size") * most_passes).cast("double")

    def sums(rows: DataFrame) -> tuple[int, int, float]:
        found = rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
        return (
            sum(r["n"] for r in found),
            sum(r["size"] for r in found),
            math.fsum(weights[r["kind"]] * r["n"] for r in found),
        )

    free = sources.where("size > 0")
    number, size, weight_of_all = sums(free)
    level, full = (size / weight_of_all if number else 0.0), 0
    while full < number:
        now_full, full_size, full_weight = sums(free.where(F.lit(level) * weight >= most))
        if now_full <= full or now_full == number:
            break
        full, level = now_full, (size - most_passes * full_size) / (weight_of_all - full_weight)
    return sources.withColumn("target", F.least(F.lit(level) * weight, most))


def plan_source(number: int, size: int, target: float, block_words: int, seed: int) -> tuple[int, int, int]:
    """How a source is taken: its blocks, the slots it fills, and the words of the last slot."""
    blocks = -(-size // block_words)
    words = min(round(target), MOST_PASSES * size)
    if not words:
        return blocks, 0, 0
    passes, rest = divmod(words, size)
    tail = size - (blocks - 1) * block_words
    if not rest:
        last = _permutation(number, passes - 1, blocks, seed).at(np.array([blocks - 1]))[0]
        return blocks, passes * blocks, tail if last == blocks - 1 else block_words
    # The one short block shifts what follows it in this pass.
    short = _permutation(number, passes, blocks, seed).place_of(blocks - 1)
    before = (rest - 1) // block_words
    if before < short:
        taken, last_words = before + 1, rest - before * block_words
    else:
        after = rest - short * block_words - tail
        if after <= 0:
            taken, last_words = short + 1, tail + after
        else:
            more = -(-after // block_words)
            taken, last_words = short + 1 + more, after - (more - 1) * block_words
    return blocks, passes * blocks + taken, last_words


def _plans(frames: Iterator[pd.DataFrame], block_words: int, seed: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = zip(frame["source_no"].tolist(), frame["size"].tolist(), frame["target"].tolist())
        planned = [plan_source(number, size, target, block_words, seed) for number, size, target in rows]
        yield frame.assign(**{name: [p[i] for p in planned] for i, name in enumerate(("blocks", "slots", "last_words"))})


def split_counts(needs: Sequence[int], slots: Sequence[int], seeds: Sequence[Sequence[int]]) -> np.ndarray:
    """Slots of each child in each shard, where shard i needs ``needs[i]`` and all needs together are
    all ``slots``: multinomial draws by what each child has left."""
    left = np.array(slots, np.int64)
    rows = np.zeros((len(needs), len(left)), np.int64)
    for draw, need, seed in zip(rows, needs, seeds):
        rng = np.random.default_rng(list(seed))
        missing = int(need)
        while missing:
            free = left - draw
            draw += np.minimum(rng.multinomial(missing, free / free.sum()), free)
            missing = int(need) - int(draw.sum())
        left -= draw
    return rows


def _drawn(frames: Iterator[pd.DataFrame], level: int, seed: int) -> Iterator[pd.DataFrame]:
    """For each child of each node: the shards that it has slots in, and how many."""
    for frame in frames:
        for node, shards, counts, children in frame[["node", "shards", "counts", "children"]].itertuples(index=False):
            numbers, slots = ([child[name] for child in children] for name in ("child", "slots"))
            drawn = split_counts(counts, slots, [(seed, level, node, shard) for shard in shards])
            at = [np.flatnonzero(column) for column in drawn.T]
            yield pd.DataFrame(
                {
                    "node": numbers,
                    "shards": [np.asarray(shards)[found] for found in at],
                    "counts": [column[found] for column, found in zip(drawn.T, at)],
                }
            )


def draw_shards(plans: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """node (a source's number) with shards and counts, arrays of the same length: the shards that
    have slots of the source, ascending, and how many each has.

    A tree over the source numbers: the root's counts are the shards' sizes, and each level splits
    the counts of a node among its children. So a task meets no more than FANOUT children at once.
    """
    spark = plans.sparkSession
    sources, total = plans.agg(F.max("source_no"), F.sum("slots")).first()
    total = total or 0
    full, rest = divmod(total, shard_slots)
    sizes = [shard_slots] * full + [rest] * (rest > 0)
    levels = 1
    while FANOUT**levels <= (sources or 0):
        levels += 1
    schema = "node long, shards array<long>, counts array<long>"
    nodes = spark.createDataFrame([(0, list(range(len(sizes))), sizes)], schema)
    for level in range(levels):
        child = F.floor(F.col("source_no") / F.lit(FANOUT ** (levels - level - 1))).cast("long")
        slots = plans.where("slots > 0").groupBy(child.alias("child")).agg(F.sum("slots").alias("slots"))
        # FANOUT at most.
        children = slots.groupBy(F.floor(F.col("child") / FANOUT).cast("long").alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("child", "slots"))).alias("children")
        )
        met = nodes.join(children.hint("merge"), "node")
        nodes = durable(met.mapInPandas(lambda frames, level=level: _drawn(frames, level, seed), schema))
    return nodes


_SLOTS = "shard long, source_no long, slot long, pass long, block long, words long"


def _slots(frames: Iterator[pd.DataFrame], seed: int, block_words: int, piece: int = 1 << 16) -> Iterator[pd.DataFrame]:
    names = [column.split()[0] for column in _SLOTS.split(", ")]
    made: list[tuple] = []
    held = 0
    wanted = ["shard", "source_no", "first", "count", "size", "blocks", "slots", "last_words"]
    for frame in frames:
        for shard, number, first, count, size, blocks, slots, last_words in frame[wanted].itertuples(index=False):
            for start in range(first, first + count, piece):
                index = np.arange(start, min(start + piece, first + count), dtype=np.int64)
                turn, place = np.divmod(index, blocks)
                block = np.empty_like(place)
                for t in np.unique(turn):
                    block[turn == t] = _permutation(number, int(t), blocks, seed).at(place[turn == t])
                words = np.minimum(block_words, size - block * block_words)
                words[index == slots - 1] = last_words
                made.append((np.full_like(index, shard), np.full_like(index, number), index, turn, block, words))
                held += len(index)
                if held >= piece:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*made)))))
                    made, held = [], 0
    if made:
        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*made)))))


@dataclass(frozen=True)
class Mix:
    """``documents``: row, doc_id, size, source_size, target, source_no and first_word, the place of
    the document's first word in its source. ``slots``: shard, source_no, slot, pass, block and the
    words taken from the block's beginning."""

    documents: DataFrame
    slots: DataFrame
    block_words: int


def plan_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = SEED,
    row: str | None = None,
) -> Mix:
    """Plan the mix of all ``docs``. A null text has no words; null is a source of its own, the last.

    Reruns over the same rows agree: documents are laid out by id, equal ids by content, and which of
    several equal rows comes first makes no difference. ``row`` names a column that numbers the rows.
    An empty table gives an empty mix. There may be any number of sources.
    """
    ship_package(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    sized = durable(
        docs.select(
            (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).alias("row"),
            F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
            F.col(f"`{source}`").cast("string").alias("source"),
            F.regexp_count(body, F.lit(_WORD)).cast("long").alias("size"),
            F.xxhash64(body).alias("content"),
        )
    )
    # No name is null where a key must be equal.
    key = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless")]
    named = sized.select("row", "doc_id", "size", "content", *key)
    totals = named.groupBy("name", "nameless").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    # Spark compares strings by their UTF-8, which is by code point.
    numbered = with_positions(totals, [F.col("nameless"), F.col("name")])
    targets = with_targets(numbered.withColumn("source_no", F.col("position") - 1).drop("position"), weights)
    added = [StructField(name, LongType()) for name in ("blocks", "slots", "last_words")]
    schema = StructType([*targets.schema.fields, *added])
    plans = durable(targets.mapInPandas(lambda frames: _plans(frames, block_words, seed), schema))
    slots = plans.agg(F.sum("slots")).first()[0] or 0
    shard_slots = max(LEAST_SHARD_SLOTS, -(-slots // MOST_SHARDS))
    drawn = draw_shards(plans, shard_slots, seed).withColumnRenamed("node", "source_no")
    shares = (
        drawn.select("source_no", F.explode(F.arrays_zip("shards", "counts")).alias("share"))
        .select("source_no", F.col("share.shards").alias("shard"), F.col("share.counts").alias("count"))
        .withColumn("first", F.sum("count").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("count"))
    )
    planned = shares.join(plans.select("source_no", "size", "blocks", "slots", "last_words"), "source_no")
    taken = dealt(planned, "shard", "source_no").mapInPandas(lambda frames: _slots(frames, seed, block_words), _SLOTS)
    described = plans.select(
        "name",
        "nameless",
        "source_no",
        F.col("size").alias("source_size"),
        "target",
        F.ceil(F.col("rows") / bucket_rows).cast("long").alias("buckets"),
    )
    # Staged, so the planner knows its size; beyond what it broadcasts, hot sources are split.
    known = join_spread(named, described, ["name", "nameless"], plans.select("name", "nameless", "rows"), "row").drop("name", "nameless")
    return Mix(_placed(known), taken, block_words)


def _placed(known: DataFrame) -> DataFrame:
    """Add first_word. A source's documents are laid out by hash bucket and by id within it, so that
    no window holds a whole source."""
    bucketed = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "content"), F.col("buckets")))
    sums = bucketed.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "source_no", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_first")
    )
    within = (
        Window.partitionBy("source_no", "bucket")
        .orderBy("doc_id", "content", "row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = bucketed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inner.join(bases, ["source_no", "bucket"]).select(
        "row",
        "doc_id",
        "size",
        "source_size",
        "target",
        "source_no",
        (F.col("bucket_first") + F.col("before")).alias("first_word"),
    )


def taken_spans(mix: Mix) -> DataFrame:
    """For each document and slot that takes words of it: shard, slot, pass and the words from
    ``from_word`` up to ``to_word`` (exclusive). A document without words, or not taken, has one row
    with null slot."""
    size = mix.block_words
    last = F.col("first_word") + F.col("size")
    pieces = mix.documents.withColumn(
        "block",
        F.explode_outer(
            F.when(
                F.col("size") > 0,
                F.sequence(
                    F.floor(F.col("first_word") / size).cast("long"), F.floor((last - 1) / size).cast("long")
                ),
            ).otherwise(F.array(-1 - F.pmod(F.xxhash64("row"), F.lit(_NO_BLOCKS))))
        ),
    )
    # The planner cannot see how many slots there are, so it must not broadcast them.
    slots = mix.slots.select("shard", "slot", "pass", "words", "source_no", "block").hint("merge")
    start = F.col("block") * size
    first = F.greatest(F.col("first_word"), start)
    stop = F.least(last, start + F.col("words"))
    joined = pieces.join(slots, ["source_no", "block"], "left").withColumns({"start": first, "stop": stop})
    within = F.col("slot").isNotNull() & (F.col("stop") > F.col("start"))
    return joined.select(
        *mix.documents.columns,
        F.when(within, F.col("shard")).alias("shard"),
        F.when(within, F.col("slot")).alias("slot"),
        F.when(within, F.col("pass")).alias("pass"),
        F.when(within, F.col("start") - F.col("first_word")).alias("from_word"),
        F.when(within, F.col("stop") - F.col("first_word")).alias("to_word"),
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of it) of each document."""
    spans = taken_spans(plan_mix(docs, **options))
    return (
        spans.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).alias("taken"))
        .drop("row")
    )


def _cut_text(text: str, size: int, spans: list[dict]) -> str:
    """The words of ``text`` in ``spans``, with what stands between them; all of it if all are taken."""
    joined: list[list[int]] = []
    for span in spans:
        if joined and span["from_word"] <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], span["to_word"])
        else:
            joined.append([span["from_word"], span["to_word"]])
    if joined == [[0, size]]:
        return text
    words = [found.span() for found in re.finditer(_WORD, text)]
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in joined)


def _taken_texts(batches: Iterator[pa.RecordBatch], text: str, size: str, spans: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, text):
            columns = (batch.column(name).to_pylist() for name in (text, size, spans))
            cut = pa.array([_cut_text(*row) for row in zip(*columns)], pa.string())
            kept = batch.select([name for name in batch.schema.names if name not in (size, spans)])
            yield kept.set_column(kept.schema.get_field_index(text), text, cut)


def mix_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The mix as rows of ``docs``: a document stands in it once for each pass over its source that
    takes words of it, with the words taken in that pass. Texts without words are in no mix."""
    ship_package(docs.sparkSession)
    number, size, spans = (free_name(docs, wish) for wish in ("row_number", "mix_size", "mix_spans"))
    numbered = durable(docs.withColumn(number, F.monotonically_increasing_id()))
    mix = plan_mix(numbered, doc_id, text, source, row=number, **options)
    taken = (
        taken_spans(mix)
        .where("slot IS NOT NULL")
        .groupBy(F.col("row").alias(number), F.col("size").alias(size), "pass")
        .agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias(spans))
        .drop("pass")
    )
    # The planner cannot see how many there are, so it must not broadcast them.
    joined = numbered.join(taken.hint("merge"), number).drop(number)
    return joined.transform(batchwise, lambda batches: _taken_texts(batches, text, size, spans), docs.schema)
