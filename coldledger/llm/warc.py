"""WARC archives, index first.

Writing gives an index: file, offset, length, URL and digest of each record. Reading selects
records in the index, sorts them by place and fetches neighbours by one byte-range read.
Records are gzip members of their own, so that each can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, new_folder, ship_package
from .arrays import batchwise, slices
from .stores import new_file, opened, spread_by_place

#: Payloads below this size are never replaced by a revisit record.
LEAST_REVISIT_BYTES = 1000
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Records that are at most so many bytes apart are fetched by one read, of at most READ_BYTES
#: unless a single record is longer.
GAP_BYTES = 1 << 16
READ_BYTES = 1 << 23
#: Date of all records, so that reruns write the same bytes.
RECORD_DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
_VERSION = "WARC/1.1"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

_INDEX = (
    "file string, offset bigint, length bigint, page_id bigint, url string, record_type string, "
    "payload_digest string, payload_bytes bigint, refers_to bigint"
)


def with_record_types(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT_BYTES
) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and, for a revisit, refers_to and refers_to_url.

    Of equal payloads of at least ``least`` bytes the record with the largest id is the response
    and the others revisit it. A null id is the smallest; records that share the largest id are
    all responses. A null payload is empty.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    base = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        payload.alias("html"),
    )
    described = base.select(
        "page_id",
        "url",
        F.octet_length("html").cast("long").alias("payload_bytes"),
        F.sha1("html").alias("payload_digest"),
        # Equality is decided by the longer digest.
        F.sha2("html", 256).alias("content"),
    ).where(F.col("payload_bytes") >= least)
    described = durable(described)
    copies = (
        described.groupBy("content")
        .agg(
            F.max("page_id").alias("refers_to"),
            F.max_by("url", "page_id").alias("refers_to_url"),
            F.count(F.lit(1)).alias("copies"),
        )
        .where("copies > 1 AND refers_to IS NOT NULL")
    )
    revisits = (
        described.join(copies, "content")
        .where("page_id IS NULL OR page_id < refers_to")
        .select(F.col("page_id").alias("of_id"), "content", "refers_to", "refers_to_url")
        .distinct()
    )
    full = base.withColumn("content", F.sha2("html", 256))
    return (
        full.join(
            revisits, full["page_id"].eqNullSafe(revisits["of_id"]) & (full["content"] == revisits["content"]), "left"
        )
        .select(
            "page_id",
            "url",
            "html",
            F.octet_length("html").cast("long").alias("payload_bytes"),
            F.sha1("html").alias("payload_digest"),
            "refers_to",
            "refers_to_url",
        )
    )


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(row: dict, record_id: str, date: str) -> bytes:
    payload = row["html"].encode()
    head = [_VERSION, f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_one_line(row['url'])}")
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    block = _HTTP_HEAD % len(payload)
    if row["refers_to"] is None:
        head.append("WARC-Type: response")
        block += payload
    else:
        head += ["WARC-Type: revisit", f"WARC-Profile: {_REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
        if row["refers_to_url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_one_line(row['refers_to_url'])}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    stream, path, place = None, "", 0
    try:
        for whole in batches:
            for batch in slices(whole, "html"):
                index = []
                for row in batch.to_pylist():
                    if stream is not None and place >= most_bytes:
                        stream.close()
                        stream = None
                    if stream is None:
                        store, path = new_file(folder, ".warc.gz")
                        stream, place = store.open_output_stream(path, compression=None), 0
                    number = hashlib.md5(f"{path}/{place}".encode()).hexdigest()
                    uid = f"{number[:8]}-{number[8:12]}-4{number[13:16]}-8{number[17:20]}-{number[20:]}"
                    member = _gzip_member(_record(row, uid, date))
                    stream.write(member)
                    index.append(
                        {
                            "file": path.rsplit("/", 1)[1],
                            "offset": place,
                            "length": len(member),
                            "page_id": row["page_id"],
                            "url": row["url"],
                            "record_type": "response" if row["refers_to"] is None else "revisit",
                            "payload_digest": row["payload_digest"],
                            "payload_bytes": row["payload_bytes"],
                            "refers_to": row["refers_to"],
                        }
                    )
                    place += len(member)
                yield pa.RecordBatch.from_pylist(index, _INDEX_TYPE)
    finally:
        if stream is not None:
            stream.close()


_INDEX_TYPE = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("refers_to", pa.int64()),
    ]
)


def write_warc(typed: DataFrame, folder: str, date: str = RECORD_DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``with_record_types`` to archives in ``folder``; the index, staged.

    An empty table gives no archive and an empty index.
    """
    ship_package(typed.sparkSession)
    return durable(typed.transform(batchwise, lambda batches: _write(batches, folder, date, archive_bytes), _INDEX))


def _parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != _VERSION:
        raise ValueError(f"not a {_VERSION} record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, block[: int(fields["Content-Length"])]


def _described(fields: dict[str, str], block: bytes, entry: dict) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of the record at {entry['file']}:{entry['offset']} is damaged")
    if digest != entry["payload_digest"]:
        raise ValueError(f"record at {entry['file']}:{entry['offset']} is not the one in the index")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": entry["url"],
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload if kind == "response" else None,
    }


def _runs(entries: Iterator[dict], gap: int, most: int) -> Iterator[list[dict]]:
    """Neighbouring entries of one file, to be fetched by one read."""
    run: list[dict] = []
    for entry in entries:
        if run and not (
            entry["file"] == run[-1]["file"]
            and entry["offset"] - run[-1]["offset"] - run[-1]["length"] <= gap
            and entry["offset"] + entry["length"] - run[0]["offset"] <= most
        ):
            yield run
            run = []
        run.append(entry)
    if run:
        yield run


_RECORD_TYPE = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _read(
    batches: Iterator[pa.RecordBatch], folder: str, with_payload: bool, gap: int, most: int
) -> Iterator[pa.RecordBatch]:
    schema = _RECORD_TYPE if with_payload else _RECORD_TYPE.remove(len(_RECORD_TYPE) - 1)
    store, top = opened(folder)
    name, source = None, None
    entries = (entry for batch in batches for entry in batch.to_pylist())
    for run in _runs(entries, gap, most):
        if run[0]["file"] != name:
            name = run[0]["file"]
            source = store.open_input_file(f"{top}/{name}")
        first = run[0]["offset"]
        data = source.read_at(run[-1]["offset"] + run[-1]["length"] - first, first)
        rows = []
        for entry in run:
            place = entry["offset"] - first
            fields, block = _parsed(data[place : place + entry["length"]])
            rows.append(_described(fields, block, entry))
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(
    index: DataFrame, folder: str, with_payload: bool = True, gap_bytes: int = GAP_BYTES, read_bytes: int = READ_BYTES
) -> DataFrame:
    """The records that ``index`` (any selection of index rows) names, parsed from the archives.

    Each payload is checked against its digest. Revisit records have a null payload.
    """
    ship_package(index.sparkSession)
    placed = spread_by_place(index.select("file", "offset", "length", "url", "payload_digest"))
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
    return placed.transform(
        batchwise,
        lambda batches: _read(batches, folder, with_payload, gap_bytes, read_bytes),
        schema + ", payload binary" * with_payload,
    )


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all ``pages`` to archives and read them back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    index = write_warc(with_record_types(pages), folder)
    return read_warc(index, folder, with_payload=False)
