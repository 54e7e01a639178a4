"""Manifests: comparison, hard links, sorting, sizes and digests.

A manifest is a DataFrame of ``filename BINARY, hash STRING``; a name may occur
more than once, and no hash is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import capitalise
from ..functions.paths import strip_root
from ..session import durable
from .skew import dealt, join_spread, semi_join_spread, sort_with_copies, with_positions

# Copies of one record are numbered in chunks of this many.
_CHUNK = 65_536
# Leading hash characters used as sub-key; hashes are uniform, and their prefixes
# sort as the hashes do.
_PREFIX_CHARS = 4
# Positions of an archive handled as one group when links look for targets.
_SEQ_SPAN = 65_536
# Hashes that two numbers can hold.
_USUAL_HASH = "^[0-9a-f]{32}$"


def _both(left: DataFrame, right: DataFrame, name: Sequence[str]) -> DataFrame:
    def side(df: DataFrame, is_left: int) -> DataFrame:
        return df.select(
            *name, "hash", F.lit(is_left).cast("bigint").alias("n_left"), F.lit(1 - is_left).cast("bigint").alias("n_right")
        )

    return side(left, 1).unionByName(side(right, 0))


def _status() -> Column:
    return (
        F.when(F.col("right_hash").isNull(), F.lit("only_left"))
        .when(F.col("left_hash").isNull(), F.lit("only_right"))
        .when(F.col("left_hash") == F.col("right_hash"), F.lit("match"))
        .otherwise(F.lit("differ"))
    )


def _half(start: int) -> Column:
    """Sixteen digits of a hash as a number, from digit ``start`` on."""
    return F.conv(F.substring("hash", start, 16), 16, -10).cast("bigint")


def _unpacked(high: Column, low: Column) -> Column:
    digits = [F.lpad(F.lower(F.hex(half)), 16, "0") for half in (high, low)]
    return F.concat(*digits)


def compare_manifests(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pair two manifests by name: match, differ, only_left or only_right.

    With ``keys``, many manifests are compared at once, those of equal keys with each other. Copies of a name pair up in hash order, first with first and so on. One hash
    aggregate by name (combined map-side, so a hot name is small) settles every
    name that occurs at most once per side: a hash of 32 lower-case hexadecimal
    digits is held as two numbers, which an aggregate can keep in place where it
    would have to sort for texts. Names that are repeated or have another kind of
    hash are numbered; the inputs are read again for those, so pass ``durable``
    or stored ones.
    """
    name = [*keys, "filename"]
    rows = _both(left, right, name)
    usual = F.col("hash").rlike(_USUAL_HASH)
    halves = {"high": F.when(usual, _half(1)), "low": F.when(usual, _half(17))}
    names = durable(
        rows.withColumns({"odd": F.when(usual, 0).otherwise(1), **halves})
        .groupBy(*name)
        .agg(
            F.sum("n_left").alias("n_left"),
            F.sum("n_right").alias("n_right"),
            F.max("odd").alias("odd"),
            *[
                F.max(F.when(F.col(f"n_{side}") > 0, F.col(half))).alias(f"{side}_{half}")
                for side in ("left", "right")
                for half in halves
            ],
        )
    )
    settled = (F.col("n_left") <= 1) & (F.col("n_right") <= 1) & (F.col("odd") == 0)
    hashes = [_unpacked(F.col(f"{side}_high"), F.col(f"{side}_low")).alias(f"{side}_hash") for side in ("left", "right")]
    pairs = names.where(settled).select(*name, F.lit(1).cast("bigint").alias("copy"), *hashes)
    # Staged, so that the planner knows how few they are.
    again = durable(names.where(~settled).select(*name, (F.col("n_left") + F.col("n_right")).alias("rows")))
    # Spread by row: a hot name's records may all have one hash.
    spread = semi_join_spread(rows.withColumn("_row", F.monotonically_increasing_id()), again, name, "_row")
    pairs = pairs.unionByName(_pair_copies(spread.drop("_row"), name))
    return pairs.withColumn("status", _status())


def _pair_copies(rows: DataFrame, name: Sequence[str]) -> DataFrame:
    """Pair the k-th left copy of each name with its k-th right copy.

    Equal records are first combined to counts. The running counts that number
    the copies are taken within one hash prefix of a name, on top of the totals
    of the smaller prefixes (at most 65,536 per name).
    """
    runs = durable(
        rows.groupBy(*name, "hash")
        .agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
        .withColumn("_prefix", F.substring("hash", 1, _PREFIX_CHARS))
    )
    group = [*name, "_prefix"]
    earlier = Window.partitionBy(*group).orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy(*name).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        runs.groupBy(*group)
        .agg(F.sum("n_left").alias("_left"), F.sum("n_right").alias("_right"))
        .select(
            *group,
            F.coalesce(F.sum("_left").over(smaller), F.lit(0)).alias("_left_base"),
            F.coalesce(F.sum("_right").over(smaller), F.lit(0)).alias("_right_base"),
        )
    )
    placed = runs.select(
        "*",
        F.coalesce(F.sum("n_left").over(earlier), F.lit(0)).alias("_left_local"),
        F.coalesce(F.sum("n_right").over(earlier), F.lit(0)).alias("_right_local"),
    ).join(totals, group)

    def side(is_left: bool, of: str) -> Column:
        return F.struct(
            F.lit(is_left).alias("_is_left"),
            (F.col(f"_{of}_base") + F.col(f"_{of}_local")).alias("_start"),
            F.col(f"n_{of}").alias("_n"),
        )

    chunks = (
        placed.select(*name, "hash", F.inline(F.array(side(True, "left"), side(False, "right"))))
        .where(F.col("_n") > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / _CHUNK))))
    )
    first = F.col("_chunk") * _CHUNK
    last = F.least(first + _CHUNK, F.col("_n")) - 1
    copies = F.sequence(F.col("_start") + first + 1, F.col("_start") + last + 1)
    is_left = F.col("_is_left")
    # Chunks are spread before their rows are written out: one record may have a
    # large share of all copies.
    spread = durable(dealt(chunks, *name, "hash", "_is_left", "_chunk"))

    def numbered(mine: Column, as_name: str) -> DataFrame:
        return spread.where(mine).select(*name, F.explode(copies).alias("copy"), F.col("hash").alias(as_name))

    return numbered(is_left, "left_hash").join(numbered(~is_left, "right_hash"), [*name, "copy"], "full")


def difference_message(left_name: str, right_name: str) -> Column:
    """Text of one difference; null for a match."""
    name = F.col("filename").cast("string")
    return (
        F.when(F.col("status") == "only_left", F.format_string(fv.ONLY_IN, F.lit(left_name), name))
        .when(F.col("status") == "only_right", F.format_string(fv.ONLY_IN, F.lit(right_name), name))
        .when(
            F.col("status") == "differ",
            F.format_string(
                fv.DIFFERENCE,
                name,
                F.lit(capitalise(left_name)),
                F.col("left_hash"),
                F.lit(capitalise(right_name)),
                F.col("right_hash"),
            ),
        )
    )


def summarise_comparison(compared: DataFrame) -> DataFrame:
    """One row: files per side, outcomes, and whether everything matched."""
    status = F.col("status")
    return compared.agg(
        F.count_if(status != "only_right").alias("left_files"),
        F.count_if(status != "only_left").alias("right_files"),
        F.count_if(status == "match").alias("matched"),
        F.count_if(status == "differ").alias("differ"),
        F.count_if(status == "only_left").alias("only_left"),
        F.count_if(status == "only_right").alias("only_right"),
    ).select(
        "*",
        (F.col("left_files") != F.col("right_files")).alias("counts_differ"),
        ((F.col("matched") == F.col("left_files")) & (F.col("matched") == F.col("right_files"))).alias("identical"),
    )


def difference_report(compared: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Messages in name order, the two count lines last when the counts differ.

    Empty when both manifests agree. ``compared`` should be ``durable``.
    """
    messages = compared.where(F.col("status") != "match").select(
        F.lit(0).alias("section"), "filename", "copy", difference_message(left_name, right_name).alias("message")
    )
    counts = F.format_string(
        fv.COUNT_LINE,
        F.lit(capitalise(left_name)),
        F.col("left_files"),
        F.lit(right_name),
        F.col("right_files"),
    )
    closing = (
        summarise_comparison(compared)
        .where("counts_differ")
        .select(F.posexplode(F.array(F.lit(fv.COUNTS_DIFFER), counts)).alias("copy", "message"))
        .select(
            F.lit(1).alias("section"),
            F.lit(None).cast("binary").alias("filename"),
            F.col("copy").cast("bigint").alias("copy"),
            "message",
        )
    )
    order = [F.col("section").asc(), F.col("filename").asc(), F.col("copy").asc()]
    return with_positions(messages.unionByName(closing), order).select("position", "message")


def sort_manifest(manifest: DataFrame) -> DataFrame:
    """Number a manifest byte-wise by name, equal names by hash; any number of records may be equal."""
    return sort_with_copies(manifest.select("filename", "hash"), [F.col("filename").asc(), F.col("hash").asc()])


def manifest_size(files: DataFrame) -> DataFrame:
    """Total bytes and number of files."""
    return files.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count(F.lit(1)).alias("files")
    )


def resolve_hard_links(members: DataFrame) -> DataFrame:
    """Manifest of archive members: files with their hash, links with their target's.

    ``members`` has ``archive, seq, name, type, linkname, hash`` with ``seq``
    unique per archive. Members that are neither file nor link are skipped. A
    link takes the hash of the latest file of that name before it; without one,
    or when it points at another link only, it stays unresolved (null hash).

    One hash aggregate by name finds where each name's file is, its hash held as
    two numbers, and how many links it has, so that a name with any share of them
    is split. Only names with several files, or with hashes of another kind, are
    filled forward by windows. ``members`` is read for files and for links: pass
    a ``durable`` or stored one.
    """
    plain = members.where(F.col("type").isin("file", "link")).select(
        "archive", "seq", "type", "hash", strip_root(F.col("name")).alias("filename"), strip_root(F.col("linkname")).alias("target")
    )
    files = plain.where(F.col("type") == "file")
    links = plain.where(F.col("type") == "link")
    is_link = F.col("type") == "link"
    steps = plain.withColumn("_key", F.when(is_link, F.col("target")).otherwise(F.col("filename")))
    usual = F.col("hash").rlike(_USUAL_HASH)
    own = lambda value: F.max(F.when(~is_link, value))
    names = durable(
        steps.groupBy("archive", "_key")
        .agg(
            F.count_if(is_link).alias("rows"),
            F.count_if(~is_link).alias("_files"),
            own(F.col("seq")).alias("_file_seq"),
            own(F.when(usual, 0).otherwise(1)).alias("_odd"),
            own(F.when(usual, _half(1))).alias("_high"),
            own(F.when(usual, _half(17))).alias("_low"),
        )
        .where((F.col("rows") > 0) & (F.col("_files") > 0))
    )
    group = ["archive", "_key"]
    several = (F.col("_files") > 1) | (F.col("_odd") > 0)
    targets = names.select(
        *group, "_file_seq", _unpacked(F.col("_high"), F.col("_low")).alias("_file_hash"), several.alias("_several")
    )
    sought = links.select("archive", "seq", "filename", F.col("target").alias("_key"))
    joined = join_spread(sought, targets, group, names.select(*group, "rows"), "seq")
    simple = joined.where(~F.coalesce("_several", F.lit(False)))
    known = F.when(F.col("_file_seq") < F.col("seq"), F.col("_file_hash"))
    versions = durable(names.where(several).select(*group, (F.col("rows") + F.col("_files")).alias("rows")))
    again = semi_join_spread(steps, versions, group, "seq")
    result = ["archive", "seq", "filename", "type", "hash"]
    return (
        files.select(*result)
        .unionByName(simple.select("archive", "seq", "filename", F.lit("link").alias("type"), known.alias("hash")))
        .unionByName(_filled_forward(again).select(*result))
    )


def _filled_forward(steps: DataFrame) -> DataFrame:
    """The links of ``steps`` with the hash of the last file of their ``_key`` before them.

    A name's rows are split by ranges of ``seq``; each range carries in the last
    hash of the ranges before it.
    """
    spans = steps.withColumn("_span", F.floor(F.col("seq") / _SEQ_SPAN)).withColumn(
        "_file_hash", F.when(F.col("type") == "file", F.col("hash"))
    )
    group = ["archive", "_key", "_span"]
    so_far = Window.partitionBy(*group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("archive", "_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spans.groupBy(*group)
        .agg(F.max_by("_file_hash", F.when(F.col("_file_hash").isNotNull(), F.col("seq"))).alias("_last"))
        .select(*group, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    )
    return (
        spans.withColumn("_local", F.last("_file_hash", ignorenulls=True).over(so_far))
        .where(F.col("type") == "link")
        .join(carried, group, "left")
        .select("archive", "seq", "filename", "type", F.coalesce("_local", "_carried").alias("hash"))
    )


def require_resolved(resolved: DataFrame) -> DataFrame:
    """The manifest of resolved members; fails the job at an unresolved link."""
    problem = F.concat(F.lit("hard link without an earlier target: "), F.col("filename").cast("string"))
    checked = F.coalesce(F.col("hash"), F.raise_error(problem).cast("string"))
    return resolved.select("archive", "seq", "filename", checked.alias("hash"))


def content_digest(content: Column) -> Column:
    """MD5 of a value, in lower-case hex."""
    return F.md5(content)


def compare_digests(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Whole-object digests of two copies, joined one to one, with a verdict."""
    return left.select(key, F.col("hash").alias("left_hash")).join(
        right.select(key, F.col("hash").alias("right_hash")), key
    ).withColumn("equal", F.col("left_hash") == F.col("right_hash"))
