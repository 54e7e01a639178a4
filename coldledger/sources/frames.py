"""Packed files made of several frames: zstd frames, or gzip members that state their length.

Such frames say how long they are, packed and unpacked, so a file can be read from any of them on
without unpacking those before. One long zstd frame, a zstd frame without its unpacked size (as
written from a pipe) and other gzip files cannot be read so.
"""

from __future__ import annotations

import gzip
import io
from array import array
from bisect import bisect_right
from typing import BinaryIO

# Fixed values of the two formats.
GZIP_MAGIC = b"\x1f\x8b"
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
_SKIPPABLE_MAGIC = range(0x184D2A50, 0x184D2A60)
_ZSTD_HEADER = 18
_ZSTD_RLE = 1
_GZIP_EXTRA_FLAG = 4
_GZIP_LENGTH_FIELD = b"BC\x02\x00"

#: Unpacked bytes that are passed over in one piece.
_PIECE = 1 << 20
#: Packed bytes that are given to zstd at once: they may unpack to 32,768 times as many.
_PACKED_PIECE = 1 << 12


def _number(data: bytes) -> int:
    return int.from_bytes(data, "little")


def _zstd_frame(stream: BinaryIO, at: int) -> tuple[int, int] | None:
    """Packed and unpacked length of the frame at ``at``; none where it does not say."""
    import zstandard

    stream.seek(at)
    head = stream.read(_ZSTD_HEADER)
    if _number(head[:4]) in _SKIPPABLE_MAGIC:
        return 8 + _number(head[4:8]), 0
    if not head.startswith(ZSTD_MAGIC):
        return None
    described = zstandard.get_frame_parameters(head)
    if described.content_size == zstandard.CONTENTSIZE_UNKNOWN:
        return None
    end = at + zstandard.frame_header_size(head)
    last = 0
    while not last:
        stream.seek(end)
        block = stream.read(3)
        if len(block) < 3:
            raise EOFError("the last frame is cut: bytes are missing at the end")
        header = _number(block)
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        end += 3 + (1 if kind == _ZSTD_RLE else size)
    return end + 4 * described.has_checksum - at, described.content_size


def _gzip_member(stream: BinaryIO, at: int) -> tuple[int, int] | None:
    """Packed and unpacked length of the member at ``at``; none where it does not say."""
    stream.seek(at)
    head = stream.read(12)
    if len(head) < 12 or not head.startswith(GZIP_MAGIC) or not head[3] & _GZIP_EXTRA_FLAG:
        return None
    extra = stream.read(_number(head[10:]))
    place = 0
    while place < len(extra) and extra[place : place + 4] != _GZIP_LENGTH_FIELD:
        place += 4 + _number(extra[place + 2 : place + 4])
    if place >= len(extra):
        return None
    packed = _number(extra[place + 4 : place + 6]) + 1
    stream.seek(at + packed - 4)
    return packed, _number(stream.read(4))


class _ZstdFrames(io.RawIOBase):
    """Unpacked zstd frames, one after another. Unlike the library's reader it fails if the last is cut."""

    def __init__(self, stream: BinaryIO) -> None:
        import zstandard

        self._stream = stream
        self._new_frame = zstandard.ZstdDecompressor().decompressobj
        self._frame = None
        self._packed, self._ready = b"", memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not self._ready:
            self._packed = self._packed or self._stream.read(_PACKED_PIECE)
            if not self._packed and self._frame:
                raise EOFError("the last frame is cut: bytes are missing at the end")
            if not self._packed:
                return 0
            self._frame = self._frame or self._new_frame()
            self._ready = memoryview(self._frame.decompress(self._packed))
            self._packed = self._frame.unused_data if self._frame.eof else b""
            if self._frame.eof:
                self._frame = None
        count = min(len(into), len(self._ready))
        into[:count], self._ready = self._ready[:count], self._ready[count:]
        return count


class FramedFile(io.RawIOBase):
    """The unpacked content of a file of several frames, with seeking by frames."""

    def __init__(self, stream: BinaryIO, packed_starts: array, starts: array, length: int) -> None:
        self._stream, self._packed_starts, self._starts = stream, packed_starts, starts
        self._length, self._at = length, 0
        self._reader: BinaryIO | None = None
        self._reader_at = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._length}[whence]
        return self._at

    def frame_of(self, offset: int) -> tuple[int, int]:
        """Where the frame that holds the byte at ``offset`` starts, packed and unpacked."""
        frame = bisect_right(self._starts, offset) - 1
        return self._packed_starts[frame], self._starts[frame]

    def readinto(self, into: memoryview) -> int:
        if self._at >= self._length:
            return 0
        packed_start, start = self.frame_of(self._at)
        if self._reader is None or not start <= self._reader_at <= self._at:
            self._reader, self._reader_at = unpacked_from(self._stream, packed_start), start
        skip(self._reader, self._at - self._reader_at)
        data = self._reader.read(min(len(into), self._length - self._at))
        into[: len(data)] = data
        self._at += len(data)
        self._reader_at = self._at
        return len(data)


def framed(stream: BinaryIO) -> FramedFile | None:
    """``stream`` as a file of frames; none where it has one only or does not tell their lengths.

    Frames are found by their lengths, without unpacking; two numbers are held for each.
    """
    stream.seek(0)
    frame_at = _gzip_member if stream.read(2) == GZIP_MAGIC else _zstd_frame
    end = stream.seek(0, io.SEEK_END)
    packed_starts, starts = array("q"), array("q")
    at = length = 0
    while at < end:
        frame = frame_at(stream, at)
        if frame is None:
            return None
        if at + frame[0] > end:
            raise EOFError(f"the last frame is cut: {at + frame[0] - end} bytes are missing at the end")
        if frame[1]:
            packed_starts.append(at)
            starts.append(length)
        at += frame[0]
        length += frame[1]
    return FramedFile(stream, packed_starts, starts, length) if len(starts) > 1 else None


def unpacked_from(stream: BinaryIO, at: int) -> BinaryIO:
    """The unpacked content of ``stream`` from the frame at ``at`` on."""
    stream.seek(at)
    magic = stream.read(2)
    stream.seek(at)
    if magic == GZIP_MAGIC:
        return gzip.GzipFile(fileobj=stream)
    return io.BufferedReader(_ZstdFrames(stream), _PIECE)


def skip(reader: BinaryIO, count: int) -> None:
    while count:
        passed = len(reader.read(min(count, _PIECE)))
        if not passed:
            raise EOFError(f"{count} bytes are missing at the end")
        count -= passed
