"""Usage reports: comma-separated text with a header row, plain or gzip."""

from __future__ import annotations

import csv
import gzip
import io
from collections import defaultdict
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..session import durable, ship_package

_GZIP_MAGIC = b"\x1f\x8b"
#: A file's beginning is read in pieces of so many bytes, until the header row has ended.
HEAD_BYTES = 1 << 18
# Heads are read by so many threads of the driver.
_THREADS = 32
# Rows of a partition have numbers of so many bits; the others of 63 number the blocks.
_ROW_BITS = 33
_SCHEME = "^([A-Za-z0-9+.-]+):/+"


def _column(name: str) -> Column:
    return F.col(f"`{name}`").alias(name)


class _Opened(io.RawIOBase):
    """A stream opened by Spark's file systems, for Python's readers."""

    def __init__(self, stream: JavaObject) -> None:
        self._stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        piece = bytes(self._stream.readNBytes(len(into)))
        into[: len(piece)] = piece
        return len(piece)


def _first_row(content: io.BufferedIOBase) -> tuple[str, ...]:
    """The cells of the first row, however long; none of an empty file."""
    head = b""
    while piece := content.read(HEAD_BYTES):
        head += piece
        lines = head.decode("utf-8-sig", "replace").splitlines(keepends=True)
        rows = csv.reader(lines)
        names = tuple(next(rows))
        if rows.line_num < len(lines):
            return names
    return names if head else ()


def _files(spark: SparkSession, path: str) -> Iterator[JavaObject]:
    """Status of each file under ``path``, which may be a pattern, in the order of names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def below(status: JavaObject) -> Iterator[JavaObject]:
        if not status.isDirectory():
            yield status
            return
        inside = system.listStatus(status.getPath())
        for child in sorted(inside, key=lambda each: each.getPath().getName()):
            if not child.getPath().getName().startswith(("_", ".")):
                yield from below(child)

    found = system.globStatus(root)
    if not found:
        raise ValueError(f"{path} does not exist")
    for status in found:
        yield from below(status)


#: How a file is read: Spark unpacks what is named .gz, tasks of ours unpack other gzip data.
#: Plain files that are no larger than the least split have nothing to gain from being split.
PLAIN, SMALL, NAMED_GZIP, OTHER_GZIP = "plain", "small plain", "named gzip", "other gzip"


def _header(spark: SparkSession, status: JavaObject) -> tuple[tuple[str, ...], str]:
    """The names in a file's header row, none for an empty file, and how the file is packed by its first bytes."""
    path = status.getPath()
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        content = io.BufferedReader(_Opened(stream), HEAD_BYTES)
        gzipped = content.peek(len(_GZIP_MAGIC)).startswith(_GZIP_MAGIC)
        kind = NAMED_GZIP if path.getName().endswith(".gz") else OTHER_GZIP if gzipped else PLAIN
        if kind == OTHER_GZIP and not path.toString().startswith("file:"):
            raise ValueError(f"{path.toString()} is gzip data; name it with a .gz ending where it is not mounted")
        names = _first_row(content if kind == PLAIN else gzip.GzipFile(fileobj=content))
    finally:
        stream.close()
    if not names:
        return (), kind
    missing = [name for name in fv.USAGE_COLUMNS if name not in names]
    if missing:
        raise ValueError(f"{path.toString()} lacks the columns {', '.join(missing)}")
    return names, kind


def _schema(names: Sequence[str]) -> T.StructType:
    """All columns as text; those that are not needed, or repeat a name, are named by their place."""
    return T.StructType(
        [
            T.StructField(name if name in fv.USAGE_COLUMNS and names.index(name) == i else f"_c{i}", T.StringType())
            for i, name in enumerate(names)
        ]
    )


def _least_split(spark: SparkSession) -> int:
    """No split but the last of a file has fewer bytes."""
    sizes = (spark.conf.get(f"spark.sql.files.{name}") for name in ("maxPartitionBytes", "openCostInBytes"))
    return max(1, min(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size) for size in sizes))


# Lines -----------------------------------------------------------------------
# A line's effect on quotes is a function of whether a quoted cell is open before it, given by its
# two values. Functions of lines compose to those of blocks, so blocks are looked at apart.


def _opens(text: Column) -> Column:
    """Whether a quoted cell is open after ``text``, which begins outside of one."""
    # Without doubled quotes, a cell that begins with a quote must end with the next one.
    single = F.regexp_replace(text, '""', "")
    rest = F.regexp_replace(single, r'(?:^|(?<=,))"[^"]*+"(?=,|\z)', "")
    return F.contains(text, F.lit('"')) & rest.rlike('(?:^|,)"')


def _stays_open(text: Column) -> Column:
    """Whether a quoted cell is open after ``text``, which begins inside of one."""
    # What follows the closing quote, up to the next comma, is no beginning of a cell.
    after = F.regexp_extract(text, r'(?s)^(?:[^"]|"")*+"(.*)\z', 1)
    closed = text.rlike(r'(?s)^(?:[^"]|"")*+"')
    return ~closed | _opens(F.concat(F.lit("."), after))


def _lines(spark: SparkSession, paths: Sequence[str], unit: int) -> DataFrame:
    """All lines of plain files with their file, block, place in the block, and effect on quotes."""
    return (
        spark.read.option("lineSep", "\n")
        .text(list(paths))
        .select(
            F.regexp_replace("_metadata.file_path", _SCHEME, "$1:/").alias("_file"),
            F.floor(F.col("_metadata.file_block_start") / unit).alias("_block"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(2**_ROW_BITS - 1)).alias("_row"),
            "value",
            _opens(F.col("value")).alias("_from_closed"),
            _stays_open(F.col("value")).alias("_from_open"),
        )
    )


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The effect of all lines of each block of a task together, and whether one of them could leave a cell open."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        names = ("_file", "_block", "_from_closed", "_from_open")
        for file, block, from_closed, from_open in zip(*(batch.column(name).to_pylist() for name in names)):
            one = found.setdefault((file, block), [False, True])
            one[:] = [from_open if state else from_closed for state in one]
    rows = [{"_file": f, "_block": b, "_from_closed": x, "_from_open": y} for (f, b), (x, y) in found.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=_EFFECT)


_EFFECT = pa.schema(
    [("_file", pa.string()), ("_block", pa.int64()), ("_from_closed", pa.bool_()), ("_from_open", pa.bool_())]
)
_PIECE = pa.schema(
    [("_file", pa.string()), ("_block", pa.int64()), ("_row", pa.int64()), ("text", pa.string()), ("_begins", pa.bool_()), ("_ends", pa.bool_())]
)


def _open_blocks(lines: DataFrame) -> list[tuple[str, int]]:
    """The blocks that begin inside a quoted cell: one row per block with quotes reaches the driver."""
    effects = (
        lines.where(F.contains("value", F.lit('"')))
        .select("_file", "_block", "_from_closed", "_from_open")
        .mapInArrow(_composed, "_file string, _block bigint, _from_closed boolean, _from_open boolean")
        .collect()
    )
    state: dict[str, tuple[int, bool]] = {}
    found: list[tuple[str, int]] = []
    for file, block, from_closed, from_open in sorted(tuple(row) for row in effects):
        before, is_open = state.get(file, (block, False))
        # Blocks without quotes leave a cell open if it was.
        found += [(file, between) for between in range(before + 1, block + 1) if is_open]
        state[file] = (block, from_open if is_open else from_closed)
    return found


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines brought together to records. A record that goes on in the next block is given in pieces."""
    place, state, begins, start, parts = None, False, True, 0, []
    out: list[tuple] = []

    def give(ends: bool) -> None:
        nonlocal parts, begins
        if parts:
            out.append((*place, start, "\n".join(parts), begins, ends))
        parts, begins = [], True

    def taken() -> pa.RecordBatch:
        nonlocal out
        columns = list(zip(*out)) if out else [[] for _ in _PIECE]
        out = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)

    for batch in batches:
        names = ("_file", "_block", "_row", "value", "_from_closed", "_from_open", "_open")
        for file, block, row, value, from_closed, from_open, is_open in zip(*(batch.column(n).to_pylist() for n in names)):
            if (file, block) != place:
                give(not state)
                place, state = (file, block), is_open
                begins = not is_open
            if not parts:
                start = row
            parts.append(value)
            state = from_open if state else from_closed
            if not state:
                give(True)
        yield taken()
    give(not state)
    yield taken()


def _split_records(spark: SparkSession, lines: DataFrame, open_blocks: list[tuple[str, int]], header: tuple[str, ...]) -> DataFrame:
    """The rows of plain files whose cells hold line breaks, each block read apart."""
    marked = spark.createDataFrame(open_blocks, "_file string, _block bigint").withColumn("_open", F.lit(True))
    kind = "_file string, _block bigint, _row bigint, text string, _begins boolean, _ends boolean"
    pieces = durable(
        lines.join(F.broadcast(marked), ["_file", "_block"], "left")
        .withColumn("_open", F.coalesce("_open", F.lit(False)))
        .select("_file", "_block", "_row", "value", "_from_closed", "_from_open", "_open")
        .mapInArrow(_records, kind)
    )
    whole = pieces.where("_begins AND _ends").select("_file", "_block", "_row", "text")
    # At most two pieces a block: each goes to the last one before it that begins a record.
    before = Window.partitionBy("_file").orderBy("_block", "_row").rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(F.col("_begins"), F.struct("_block", "_row")), ignorenulls=True).over(before)
    joined = (
        pieces.where("NOT (_begins AND _ends)")
        .withColumn("_first", first)
        .groupBy("_file", "_first")
        .agg(F.array_sort(F.collect_list(F.struct("_block", "_row", "text"))).alias("parts"))
        .select("_file", "_first._block", "_first._row", F.array_join("parts.text", "\n").alias("text"))
    )
    # The schema is all text, as the scans of other files have it.
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}
    text = F.regexp_replace("text", r"\r\z", "")
    named = ", ".join(f"`{field.name}` STRING" for field in _schema(header).fields)
    parsed = F.from_csv(text, named, options)
    is_header = (F.col("_block") == 0) & (F.col("_row") == 0)
    return (
        whole.unionByName(joined)
        .where(~is_header & (F.trim(text) != ""))
        .select("_file", "_block", "_row", parsed.alias("parsed"))
        .select(*[F.coalesce(F.col(f"parsed.`{name}`"), F.lit("")).alias(name) for name in fv.USAGE_COLUMNS], "_file", "_block", "_row")
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of gzip files under other names, streamed."""
    names = [*fv.USAGE_COLUMNS, "_file", "_block", "_row"]
    for batch in batches:
        for file in batch.column("_file").to_pylist():
            with gzip.open(unquote(file.removeprefix("file:")), "rt", encoding="utf-8-sig", errors="replace", newline="") as stream:
                rows = csv.reader(stream)
                header = next(rows)
                places = [header.index(name) for name in fv.USAGE_COLUMNS]
                out: list[tuple] = []

                def taken() -> pa.RecordBatch:
                    columns = list(zip(*out)) if out else [[] for _ in names]  # noqa: B023
                    kinds = [pa.string()] * 6 + [pa.int64()] * 2
                    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

                for number, row in enumerate(rows):
                    if row:
                        out.append((*(row[k] if k < len(row) else "" for k in places), file, 0, number))
                    if len(out) >= 10_000:
                        yield taken()
                        out = []
                yield taken()


def _require_closed_quotes(lines: DataFrame) -> None:
    """Fail if a line of plain files ends within a quoted cell."""
    found = lines.where(F.contains("value", F.lit('"')) & F.col("_from_closed")).first()
    if found is not None:
        raise ValueError(f"{found['_file']} has a line with an unclosed quote; read it with multi_line=True")


def read_usage_report(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """The report's five needed columns as text, plus ``seq``.

    Columns are found by header name; order and extra columns do not matter, and every file may
    have its own. Files with the same header are one scan, and no job runs per file. An empty cell
    is an empty text. ``seq`` counts up through the paths in the order given (a file named twice
    is read once), through the files of a directory by name, and through the lines of each file,
    however Spark deals the files to tasks.

    Gzip data is known by its first bytes, whatever the file's name, and is one task a file. Plain
    files larger than the least split are split between tasks. Their quotes are looked at first: if a cell holds a line
    break, it is found by the prefix of what the blocks before do to quotes, and blocks are parsed
    apart from there. Without ``multi_line`` such a cell is an error in plain files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = list({status.getPath().toUri().toString(): status for path in paths for status in _files(spark, path)}.items())
    with ThreadPoolExecutor(_THREADS) as pool:
        headers = list(pool.map(lambda file: _header(spark, file[1]), files))
    unit, block = _least_split(spark), 0
    same_header: dict[tuple[tuple[str, ...], str], list[str]] = defaultdict(list)
    first_blocks: list[tuple[str, int]] = []
    for (name, status), (header, kind) in zip(files, headers):
        if header:
            if kind == PLAIN and multi_line and status.getLen() <= unit:
                kind = SMALL
            same_header[header if kind != OTHER_GZIP else (), kind].append(status.getPath().toString())
            first_blocks.append((name, block))
            block += 1 + status.getLen() // unit
    if not same_header:
        raise ValueError(f"no file of {', '.join(paths)} has a header row")
    if block >> (63 - _ROW_BITS):
        raise ValueError("too many blocks to number; raise spark.sql.files.openCostInBytes")
    scans = [
        scan for (header, kind), same in same_header.items() for scan in _scans(spark, header, kind, same, unit, multi_line)
    ]
    # As small as the list of files that the driver holds; the planner knows its size.
    ranks = spark.createDataFrame(first_blocks, "_file string, _first bigint").withColumn(
        "_file", F.regexp_replace("_file", _SCHEME, "$1:/")
    )
    first = F.coalesce("_first", F.raise_error(F.concat(F.lit("unlisted file "), F.col("_file"))).cast("bigint"))
    return (
        reduce(DataFrame.unionByName, scans)
        .join(ranks, "_file", "left")
        .select(
            *[_column(name) for name in fv.USAGE_COLUMNS],
            (F.shiftleft(first + F.col("_block"), _ROW_BITS) + F.col("_row")).alias("seq"),
        )
    )


def _scans(
    spark: SparkSession, header: tuple[str, ...], kind: str, same: list[str], unit: int, multi_line: bool
) -> list[DataFrame]:
    """The rows of files of one kind and header, with file, block and place in the block."""
    if kind == OTHER_GZIP:
        ship_package(spark)
        uris = [(status.getPath().toUri().toString(),) for path in same for status in _files(spark, path)]
        listed = spark.createDataFrame(uris, "_file string").withColumn("_file", F.regexp_replace("_file", _SCHEME, "$1:/"))
        schema = T.StructType([T.StructField(name, T.StringType()) for name in (*fv.USAGE_COLUMNS, "_file")])
        schema = schema.add("_block", T.LongType()).add("_row", T.LongType())
        return [listed.repartition(len(uris), "_file").mapInArrow(_unpacked, schema)]
    if kind == PLAIN:
        lines = _lines(spark, same, unit)
        if not multi_line:
            _require_closed_quotes(lines)
        elif lines.agg(F.bool_or("_from_closed").alias("any")).first()["any"]:
            ship_package(spark)
            return [_split_records(spark, lines, _open_blocks(lines), header)]
    return [
        spark.read.schema(_schema(header))
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", kind != PLAIN)
        .csv(same)
        .select(
            *[F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name) for name in fv.USAGE_COLUMNS],
            F.regexp_replace("_metadata.file_path", _SCHEME, "$1:/").alias("_file"),
            F.floor(F.col("_metadata.file_block_start") / unit).alias("_block"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(2**_ROW_BITS - 1)).alias("_row"),
        )
    ]


def write_usage_report(report: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the report columns as CSV with a header."""
    columns = [_column(name) for name in report.columns if name != "seq"]
    report.select(*columns).write.option("header", True).option("escape", '"').option(
        "compression", compression
    ).csv(path)
