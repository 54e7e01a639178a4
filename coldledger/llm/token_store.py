"""Token ids in binary files, packed by one canonical Huffman code.

The code is built from the counts of ids over all documents and limited to 16 bits, so that one
table lookup decodes an id. A file is a run of blocks; each block starts at a whole byte, has a
checkpoint (a bit offset) every CHECK_IDS ids, and is decoded without the others. Blocks hold whole
documents: a document of more than BLOCK_IDS ids is a block of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, new_folder, ship_package
from .arrays import batchwise, byte_view, slices, texts_of
from .stores import new_file, opened, spread_by_place
from .vocabularies import encoder, public_path, ship_tokenizer

#: The id that ends each document.
END_ID = 1
MOST_BITS = 16
#: A checkpoint every so many ids, and so many ids a block.
CHECK_IDS = 512
BLOCK_IDS = 1 << 18
#: A file is closed once it has so many bytes.
FILE_BYTES = 1 << 28
_MAGIC = b"TIDS0001"
_BLOCK_HEAD = struct.Struct("<QQQQ")  # ids, documents, bytes of packed bits, bytes of the document table


def code_lengths(counts: np.ndarray, most_bits: int = MOST_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most_bits`` bits (package-merge); 0 where the
    count is 0. A single used id has length 1."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most_bits:
        raise ValueError(f"{len(used)} ids do not fit into codes of {most_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, origins = leaves, [np.arange(len(leaves))]
    for _ in range(most_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        merged = both[place]
        origins.append(place)
    # Walk back: how many of each level's items are taken.
    depth = np.zeros(len(leaves), np.int64)
    take = 2 * len(leaves) - 2
    for place in reversed(origins):
        chosen = place[:take]
        depth[chosen[chosen < len(leaves)]] += 1
        take = 2 * int((chosen >= len(leaves)).sum())
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    steps = np.uint64(1) << (np.uint64(MOST_BITS) - lengths[order].astype(np.uint64))
    starts = np.cumsum(steps) - steps
    codes[order] = (starts >> (np.uint64(MOST_BITS) - lengths[order].astype(np.uint64))).astype(np.uint32)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each 16 bits that a code may begin."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (MOST_BITS - lengths[order].astype(np.int64))
    ids = np.zeros(1 << MOST_BITS, np.uint32)
    bits = np.zeros(1 << MOST_BITS, np.uint8)
    filled = int(spans.sum())
    ids[:filled] = np.repeat(order, spans)
    bits[:filled] = np.repeat(lengths[order], spans)
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Packed bits of ``ids`` and the bit offset of every CHECK_IDS-th id."""
    size = lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id has no code")
    ends = np.cumsum(size)
    starts = ends - size
    # A code touches two 16-bit words at most; bits of different codes never meet, so sums are unions.
    word = starts >> 4
    wide = codes[ids].astype(np.int64) << (32 - (starts & 15) - size)
    words = np.bincount(word, wide >> 16, minlength=int(word[-1]) + 2) if len(ids) else np.zeros(0)
    low = np.bincount(word + 1, wide & 0xFFFF, minlength=len(words)) if len(ids) else np.zeros(0)
    packed = (words + low).astype(">u2").tobytes()
    total = int(ends[-1]) if len(ids) else 0
    return packed[: (total + 7) // 8], starts[::CHECK_IDS]


def unpack(packed: bytes, checkpoints: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids of a block. Its stretches between checkpoints are decoded side by side."""
    ids, bits = table
    data = np.frombuffer(packed + b"\0\0\0\0", np.uint8).astype(np.uint32)
    place = checkpoints.astype(np.int64).copy()
    out = np.zeros((len(place), CHECK_IDS), np.uint32)
    last = count - (len(place) - 1) * CHECK_IDS
    for step in range(CHECK_IDS if len(place) > 1 else last):
        if step == last:
            place = place[:-1]
        byte = place >> 3
        window = (data[byte] << 16) | (data[byte + 1] << 8) | data[byte + 2]
        look = (window >> (8 - (place & 7)).astype(np.uint32)) & 0xFFFF
        out[: len(place), step] = ids[look]
        size = bits[look]
        if not size.all():
            raise ValueError("bits that are no code")
        place = place + size
    return out.reshape(-1)[:count]


@dataclass(frozen=True)
class Codebook:
    lengths: np.ndarray

    def dumped(self) -> bytes:
        body = zlib.compress(self.lengths.tobytes())
        return _MAGIC + struct.pack("<II", len(self.lengths), len(body)) + body

    @staticmethod
    def loaded(head: bytes) -> Codebook:
        if head[:8] != _MAGIC:
            raise ValueError("not a file of packed token ids")
        size, packed = struct.unpack("<II", head[8:16])
        return Codebook(np.frombuffer(zlib.decompress(head[16 : 16 + packed]), np.uint8, size))


def _tokenized(batches: Iterator[pa.RecordBatch], shipped: Broadcast) -> Iterator[pa.RecordBatch]:
    made = encoder(shipped)
    end = np.array([END_ID], made.dtype).tobytes()
    before = 0
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = [found + end for found in made.encode(texts_of(batch.column("text")))]
            sizes = np.array([len(found) // made.dtype.itemsize for found in ids], np.int64)
            ends = before + np.cumsum(sizes)
            before = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sizes), pa.array(ends - sizes)],
                ["doc_id", "ids", "n_tokens", "before"],
            )


def tokenized(docs: DataFrame, shipped: Broadcast, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, doc_id, ids (binary), n_tokens and before (the number of ids ahead in the part), staged.

    Parts are ranges of ascending doc_id, documents within them ascend; those with equal ids follow
    their text. Every document is ended by END_ID; a null text is empty, a null id comes first.
    """
    ship_package(docs.sparkSession)
    ordered = (
        docs.select(
            F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        )
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    encoded = ordered.transform(
        batchwise,
        lambda batches: _tokenized(batches, shipped), "doc_id bigint, ids binary, n_tokens bigint, before bigint"
    )
    return durable(encoded.withColumn("part", F.spark_partition_id()))


def _counted(batches: Iterator[pa.RecordBatch], dtype: str, size: int) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(size, np.int64)
    for whole in batches:
        for batch in slices(whole, "ids"):
            totals += np.bincount(byte_view(batch.column("ids"))[0].view(dtype), minlength=size)
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["id", "count"])


def global_counts(tokens: DataFrame, size: int, dtype: str) -> np.ndarray:
    """Count of each id over all documents; one row per id reaches the driver, ``size`` at most."""
    counted = tokens.select("ids").transform(batchwise, lambda batches: _counted(batches, dtype, size), "id bigint, count bigint")
    found = counted.groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    return counts


def _block(ids: list[np.ndarray], docs: list[int | None], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    joined = np.concatenate(ids)
    packed, checks = pack(joined, codes, lengths)
    known = np.array([doc is not None for doc in docs], np.uint8)
    names = np.array([doc or 0 for doc in docs], "<i8")
    sizes = np.array([len(x) for x in ids], "<u8")
    table = zlib.compress(known.tobytes() + names.tobytes() + sizes.tobytes() + checks.astype("<u8").tobytes())
    return _BLOCK_HEAD.pack(len(joined), len(docs), len(packed), len(table)) + table + packed


def read_block(data: bytes, table: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Id and token ids of each document of a block."""
    count, n_docs, packed_size, table_size = _BLOCK_HEAD.unpack_from(data)
    start = _BLOCK_HEAD.size
    listed = zlib.decompress(data[start : start + table_size])
    known = np.frombuffer(listed, np.uint8, n_docs)
    names = np.frombuffer(listed, "<i8", n_docs, n_docs)
    sizes = np.frombuffer(listed, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    checks = np.frombuffer(listed, "<u8", -1, 17 * n_docs)
    ids = unpack(data[start + table_size : start + table_size + packed_size], checks, count, table)
    ends = np.cumsum(sizes)
    for i in range(n_docs):
        yield (int(names[i]) if known[i] else None), ids[ends[i] - sizes[i] : ends[i]]


def _written(
    batches: Iterator[pa.RecordBatch], folder: str, book: Codebook, dtype: str, block_ids: int, file_bytes: int
) -> Iterator[pa.RecordBatch]:
    codes = canonical_codes(book.lengths)
    stream, name, place = None, "", 0
    ids: list[np.ndarray] = []
    docs: list[int | None] = []
    part, first, after = None, 0, 0

    def flushed() -> list[dict]:
        nonlocal stream, name, place, ids, docs
        if not docs:
            return []
        if stream is not None and place >= file_bytes:
            stream.close()
            stream = None
        if stream is None:
            store, path = new_file(folder, ".tids")
            stream, name = store.open_output_stream(path, compression=None), path.rsplit("/", 1)[1]
            head = book.dumped()
            stream.write(head)
            place = len(head)
        block = _block(ids, docs, codes, book.lengths)
        stream.write(block)
        row = {"part": part, "first": first, "file": name, "offset": place, "length": len(block)}
        place += len(block)
        ids, docs = [], []
        return [row]

    try:
        for batch in batches:
            rows: list[dict] = []
            data, offsets = byte_view(batch.column("ids"))
            columns = (batch.column(c).to_pylist() for c in ("part", "doc_id", "before"))
            for i, (its_part, doc, before) in enumerate(zip(*columns)):
                found = data[offsets[i] : offsets[i + 1]].view(dtype).astype(np.uint32)
                if its_part != part or before != after or after - first + len(found) > block_ids:
                    rows += flushed()
                    part, first = its_part, before
                ids.append(found)
                docs.append(doc)
                after = before + len(found)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _BLOCK_TYPE)
        if docs:
            yield pa.RecordBatch.from_pylist(flushed(), _BLOCK_TYPE)
    finally:
        if stream is not None:
            stream.close()


_BLOCK_TYPE = pa.schema(
    [("part", pa.int32()), ("first", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def write_tokens(
    tokens: DataFrame, folder: str, book: Codebook, dtype: str, block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write the documents of ``tokens``; the index: file, offset and length of each block and the
    number of ids before it in the whole, staged.

    Of each part only its number of ids meets the others' in one task.
    """
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        tokens.groupBy("part")
        .agg(F.sum("n_tokens").alias("part_tokens"))
        .select("part", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("base"))
    )
    blocks = tokens.select("part", "doc_id", "ids", "before").transform(
        batchwise,
        lambda batches: _written(batches, folder, book, dtype, block_ids, file_bytes),
        "part int, first bigint, file string, offset bigint, length bigint",
    )
    return durable(durable(blocks).join(bases, "part").select("file", "offset", "length", (F.col("base") + F.col("first")).alias("start")))


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    store, top = opened(folder)
    name, source, table = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["file"] != name:
                name = row["file"]
                source = store.open_input_file(f"{top}/{name}")
                head = source.read_at(16, 0)
                head += source.read_at(struct.unpack("<II", head[8:])[1], 16)
                table = decoding_table(Codebook.loaded(head).lengths)
            docs, starts, sizes, sums, all_ids = [], [], [], [], []
            start = row["start"]
            for doc, ids in read_block(source.read_at(row["length"], row["offset"]), table):
                docs.append(doc)
                starts.append(start)
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                start += len(ids)
            arrays = [pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)


def read_tokens(index: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and the ids) of the documents in the blocks of ``index``."""
    ship_package(index.sparkSession)
    return spread_by_place(index).select("file", "offset", "length", "start").transform(
        batchwise,
        lambda batches: _read(batches, folder, with_ids),
        "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids,
    )


def stored_tokens(
    docs: DataFrame,
    tokenizer: str | None = None,
    folder: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Write the token ids of all ``docs`` to packed files and read them back."""
    spark = docs.sparkSession
    definition = tokenizer or public_path("word_bpe_49k.json")
    shipped = ship_tokenizer(spark, definition)
    made = encoder(shipped)
    folder = folder or new_folder(spark, "tokens")
    tokens = tokenized(docs, shipped, doc_id, text)
    size = max(made.size, END_ID + 1)
    book = Codebook(code_lengths(global_counts(tokens, size, made.dtype.str)))
    return read_tokens(write_tokens(tokens, folder, book, made.dtype.str), folder, with_ids)
