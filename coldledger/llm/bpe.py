"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut into content-defined chunks. Chunks that occur more than once in the corpus are
encoded once, in a dictionary; the rest of a text is encoded where the text is read, and a text
without shared chunks is finished there and moves nowhere. Where pieces meet, the text around
the joint is encoded again, over ever wider stretches, until both ends agree with their pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, ship_package
from .arrays import batchwise, byte_view, slices, texts_of
from .chunking import chunk_ends
from .vocabularies import Encoder, encoder, public_path, ship_tokenizer

#: A chunk has 2 ** CHUNK_BITS bytes on average.
CHUNK_BITS = 10
#: The filter that tells shared chunks has FILTER_BITS_PER_CHUNK bits per shared chunk, and
#: MOST_FILTER_BITS at most. A chunk that it takes for shared in error costs a detour, no more.
FILTER_BITS_PER_CHUNK = 16
MOST_FILTER_BITS = 1 << 28
_PROBES = 4
# Between a printable ASCII character and ASCII white space no token and no word rule reaches over.
_SAFE = re.compile(rb"[!-~](?=[ \t\n\r\x0b\x0c])")


def _digests(raw: bytes, borders: Sequence[int]) -> list[bytes]:
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(borders, borders[1:])]


def _cut(batch: pa.RecordBatch, chunk_bits: int) -> tuple[bytes, list[int], list[bytes], list[int]]:
    data, offsets = byte_view(batch.column("text"))
    ends, owners = chunk_ends(data, offsets, chunk_bits)
    raw, borders = data.tobytes(), [0, *ends.tolist()]
    firsts = np.searchsorted(owners, np.arange(batch.num_rows + 1)).tolist()
    return raw, borders, _digests(raw, borders), firsts


def _all_digests(batches: Iterator[pa.RecordBatch], chunk_bits: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(_cut(batch, chunk_bits)[2], pa.binary())], ["digest"])


def _places(digests: Sequence[bytes], bits: int) -> np.ndarray:
    """_PROBES filter places of each digest."""
    return np.frombuffer(b"".join(digests), "<u4").reshape(-1, _PROBES) & np.uint32(bits - 1)


def _filter_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held = np.zeros(bits // 8, np.uint8)
    for batch in batches:
        if batch.num_rows:
            place = _places(batch.column("digest").to_pylist(), bits).ravel()
            np.bitwise_or.at(held, place >> 3, (1 << (place & 7)).astype(np.uint8))
    words = held.view("<i8")
    used = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], ["place", "word"])


def shared_filter(shared: DataFrame, most_bits: int = MOST_FILTER_BITS) -> np.ndarray:
    """Filter bytes for the ``digest`` column of ``shared``; ``most_bits`` / 64 rows reach the driver at most."""
    bits = 1 << 16
    wanted = min(most_bits, FILTER_BITS_PER_CHUNK * shared.count())
    while bits < wanted:
        bits *= 2
    words = (
        shared.transform(batchwise, lambda batches: _filter_words(batches, bits), "place bigint, word bigint")
        .groupBy("place")
        .agg(F.bit_or("word").alias("word"))
        .toPandas()
    )
    held = np.zeros(bits // 64, "<i8")
    held[words["place"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return held.view(np.uint8)


def _hits(digests: Sequence[bytes], held: np.ndarray) -> np.ndarray:
    if not digests:
        return np.zeros(0, bool)
    place = _places(digests, len(held) * 8)
    return ((held[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(axis=1)


class _Finisher:
    """Token counts, hashes and decoded text of finished id sequences."""

    def __init__(self, made: Encoder) -> None:
        self.made = made
        self.bytes_of = made.byte_table()
        self.names = [str(i) for i in range(made.size)]

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def row(self, packed: bytes) -> tuple[int, str, str]:
        ids = np.frombuffer(packed, self.made.dtype).tolist()
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        listed = ",".join(map(self.names.__getitem__, ids))
        return (
            len(ids),
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )


_FINAL = ["row", "piece", "digest", "ids", "text", "n_tokens", "ids_sha256", "decoded_sha256", "kept_columns"]
_PLAIN_TYPES = [
    pa.int64(),
    pa.int64(),
    pa.binary(),
    pa.binary(),
    pa.string(),
    pa.int64(),
    pa.string(),
    pa.string(),
]
_SPARK_TYPES = (
    "row bigint, piece bigint, digest binary, ids binary, text string, n_tokens bigint, "
    "ids_sha256 string, decoded_sha256 string, kept_columns "
)


def _first_pass(
    batches: Iterator[pa.RecordBatch], shipped: Broadcast, held: Broadcast, chunk_bits: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    """Finished documents (piece null), pieces encoded here (ids), pieces by reference (digest only)
    and, once a task, the text of each chunk referred to (row null)."""
    made = encoder(shipped)
    finisher = _Finisher(made)
    filtered = np.frombuffer(held.value, np.uint8)
    sent: set[bytes] = set()
    number = TaskContext.get().partitionId() << 33
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, borders, digests, firsts = _cut(batch, chunk_bits)
            shared = _hits(digests, filtered)
            rows: list[list] = []
            origin: list[int | None] = []
            waiting: list[tuple[int, str]] = []  # place in rows, text
            for i, text in enumerate(texts_of(batch.column("text"))):
                a, b = firsts[i], firsts[i + 1]
                if not shared[a:b].any():
                    waiting.append((len(rows), text))
                    rows.append([number, None, None, None, None, None, None, None])
                    origin.append(i)
                else:
                    piece, start = 0, a
                    for c in range(a, b + 1):
                        if c < b and not shared[c]:
                            continue
                        if start < c:
                            waiting.append((len(rows), raw[borders[start] : borders[c]].decode()))
                            rows.append([number, piece, None, None, None, None, None, None])
                            origin.append(i if piece == 0 else None)
                            piece += 1
                        if c < b:
                            rows.append([number, piece, digests[c], None, None, None, None, None])
                            origin.append(i if piece == 0 else None)
                            piece += 1
                            if digests[c] not in sent:
                                if len(sent) >= 1 << 18:
                                    sent.clear()
                                sent.add(digests[c])
                                chunk = raw[borders[c] : borders[c + 1]].decode()
                                rows.append([None, None, digests[c], None, chunk, None, None, None])
                                origin.append(None)
                        start = c + 1
                number += 1
            for (place, _), ids in zip(waiting, made.encode([text for _, text in waiting])):
                if rows[place][1] is None:
                    rows[place][5:8] = finisher.row(ids)
                    rows[place][3] = ids if with_ids else None
                else:
                    rows[place][3] = ids
            columns = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), _PLAIN_TYPES)]
            columns.append(batch.column("kept_columns").take(pa.array(origin, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, _FINAL)


def _encode_chunks(batches: Iterator[pa.RecordBatch], shipped: Broadcast) -> Iterator[pa.RecordBatch]:
    made = encoder(shipped)
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = made.encode(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(ids, pa.binary())], ["digest", "chunk_ids"])


def _first_safe(text: bytes) -> int | None:
    found = _SAFE.search(text)
    return found.end() if found else None


def _last_safe(text: bytes) -> int | None:
    for size in (256, 4096, len(text)):
        begin = max(0, len(text) - size)
        found = None
        for found in _SAFE.finditer(text, begin):
            pass
        if found:
            return found.end()
    return None


def joined_ids(pieces: Sequence[np.ndarray], finisher: _Finisher) -> bytes:
    """The ids of the text that ``pieces``, each encoded alone, make up together.

    Ids of a piece count between its first and last safe place, where its own ids have a border
    too. The text from the last safe place before a joint to the first one after it is encoded
    again; where a piece has no such place the stretch goes on through it.
    """
    if len(pieces) == 1:
        return pieces[0].tobytes()
    made, out = finisher.made, []
    open_text = b""
    for number, ids in enumerate(pieces):
        text = finisher.decoded(ids)
        ends = np.cumsum([len(finisher.bytes_of[i]) for i in ids.tolist()]) if len(ids) else np.zeros(0, np.int64)

        def place(at: int | None) -> int | None:
            """Number of ids before byte ``at``, if they end there."""
            if at is None:
                return None
            before = int(np.searchsorted(ends, at))  # noqa: B023
            return before + 1 if before < len(ends) and ends[before] == at else None  # noqa: B023

        first = 0 if number == 0 else _first_safe(text)
        first_id = 0 if number == 0 else place(first)
        last = _last_safe(text)
        last_id = place(last)
        if first_id is None or last_id is None or last < first:
            open_text += text
            continue
        if number:
            out.append(made.encode([(open_text + text[:first]).decode()])[0])
        out.append(ids[first_id:last_id].tobytes())
        open_text = text[last:]
    if open_text:
        out.append(made.encode([open_text.decode()])[0])
    return b"".join(out)


def _assembled(batches: Iterator[pa.RecordBatch], shipped: Broadcast, with_ids: bool) -> Iterator[pa.RecordBatch]:
    made = encoder(shipped)
    finisher = _Finisher(made)
    row, pieces, kept = None, [], None
    done: list[tuple] = []
    waiting = 0

    def finish() -> None:
        nonlocal waiting
        ids = joined_ids(pieces, finisher)
        done.append((row, *finisher.row(ids), ids if with_ids else None, kept))
        waiting += len(ids) if with_ids else 100

    def taken(schema: pa.Schema) -> pa.RecordBatch:
        nonlocal done, waiting
        names = ["row", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        arrays = [pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)]
        whole = pa.concat_arrays([d[5] for d in done]).cast(schema.field("kept_columns").type)
        done, waiting = [], 0
        return pa.RecordBatch.from_arrays([*arrays, whole], [*names, "kept_columns"])

    schema = None
    for batch in batches:
        schema = batch.schema
        numbers, all_ids = batch.column("row").to_pylist(), batch.column("ids").to_pylist()
        first = batch.column("piece").to_pylist()
        for i, number in enumerate(numbers):
            if number != row and row is not None:
                finish()
                pieces = []
                if waiting > 1 << 20:
                    yield taken(schema)
            row = number
            pieces.append(np.frombuffer(all_ids[i], made.dtype))
            if first[i] == 0:
                kept = batch.column("kept_columns").slice(i, 1)
    if row is not None:
        finish()
    if done:
        yield taken(schema)


def encode_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    text: str = "text",
    chunk_bits: int = CHUNK_BITS,
    most_filter_bits: int = MOST_FILTER_BITS,
    with_ids: bool = True,
) -> DataFrame:
    """n_tokens, ids_sha256, decoded_sha256, ids (packed little-endian, null without ``with_ids``) and
    ``kept_columns`` (a struct of all columns but the text) of each row of ``docs``.

    Ids are those of the tokenizers library without special tokens added. A null text is empty and
    has no ids; repeated rows are rows of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shipped = ship_tokenizer(spark, tokenizer or public_path("byte_bpe_50k.json"))
    others = [docs[f"`{name}`"] for name in docs.columns if name != text]
    source = docs.select(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_"), *others).alias("kept_columns"),
    )
    kept_type = source.schema["kept_columns"].dataType.simpleString()
    digests = source.select("text").transform(batchwise, lambda batches: _all_digests(batches, chunk_bits), "digest binary")
    shared = durable(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("digest"))
    held = spark.sparkContext.broadcast(shared_filter(shared, most_filter_bits).tobytes())
    found = durable(
        source.transform(
            batchwise,
            lambda batches: _first_pass(batches, shipped, held, chunk_bits, with_ids), _SPARK_TYPES + kept_type
        )
    )
    outcome = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "kept_columns"]
    finished = found.where("row IS NOT NULL AND piece IS NULL").select(*outcome)
    dictionary = (
        found.where("row IS NULL")
        .select("digest", "text")
        .dropDuplicates(["digest"])
        .transform(batchwise, lambda batches: _encode_chunks(batches, shipped), "digest binary, chunk_ids binary")
    )
    # The planner cannot see how long the ids are, so it must not broadcast them.
    references = (
        found.where("piece IS NOT NULL AND digest IS NOT NULL")
        .select("row", "piece", "digest", "kept_columns")
        .join(dictionary.hint("merge"), "digest")
        .select("row", "piece", F.col("chunk_ids").alias("ids"), "kept_columns")
    )
    own = found.where("piece IS NOT NULL AND digest IS NULL").select("row", "piece", "ids", "kept_columns")
    assembled = (
        own.unionByName(references)
        .repartition("row")
        .sortWithinPartitions("row", "piece")
        .transform(
            batchwise,
            lambda batches: _assembled(batches, shipped, with_ids),
            f"row bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids binary, kept_columns {kept_type}",
        )
        .select(*outcome)
    )
    return finished.unionByName(assembled)


def encoding_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = encode_documents(plain, tokenizer, with_ids=False)
    return found.select("kept_columns.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _decoded(batches: Iterator[pa.RecordBatch], shipped: Broadcast) -> Iterator[pa.RecordBatch]:
    made = encoder(shipped)
    finisher = _Finisher(made)
    for whole in batches:
        for batch in slices(whole, "ids"):
            texts = [
                None if ids is None else finisher.decoded(np.frombuffer(ids, made.dtype)).decode("utf-8", "replace")
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"]
            )


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``encoded`` (with packed ``ids``) and the text they stand for in a column ``decoded``; null ids give null."""
    spark = encoded.sparkSession
    ship_package(spark)
    shipped = ship_tokenizer(spark, tokenizer or public_path("byte_bpe_50k.json"))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.transform(batchwise, lambda batches: _decoded(batches, shipped), schema)
