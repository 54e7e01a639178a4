"""Encoding with a public tokenizer, remembering pieces of text that were encoded before."""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: A worker remembers pieces, none longer than LONGEST_PIECE, of about so many bytes at most, their objects included.
KNOWN_BYTES = 24 << 20
LONGEST_PIECE = 48
# Pieces that the library gets at once: what it returns for each is some kilobytes.
_AT_ONCE = 1024
_BLANK = r" \t\n\r\x0b\x0c"
_PIECE = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
# Other characters that some definition of white space has: such texts are encoded whole.
_ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

_encoders: dict[str, Encoder] = {}


def ship_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file at ``path`` on the driver, for use in tasks."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encoder(shipped: Broadcast) -> Encoder:
    """The worker's encoder for a shipped tokenizer file."""
    key = hashlib.sha256(shipped.value.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(shipped.value)
    return _encoders[key]


def public_path(name: str) -> str:
    """Where the named file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters
    stand for their own code, the other bytes in order for the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [byte for byte in range(256) if byte not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


# How the two kinds of public vocabularies tell words apart.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTROLS = re.compile("[\x1c-\x1f]")
# Texts of Latin letters whose lower case and composition are the same in all versions of Unicode,
# without odd white space.
_LATIN = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u017f]*")
#: Ends a word; never in a Latin text.
_END = "\U0010ffff"


def _latin_words() -> re.Pattern[str]:
    """``_WORDS`` over lower-case Latin texts, without classes that this library lacks."""
    letters = [chr(c) for c in range(0x180)]
    alphabetic = "".join(x for x in letters if unicodedata.category(x)[0] == "L")
    numeric = "".join(x for x in letters if unicodedata.category(x)[0] == "N")
    return re.compile(_WORDS.replace(r"\p{L}", alphabetic).replace(r"\p{N}", numeric))


class _LatinBpe:
    """Ids of Latin texts by the same merges in another, faster library.

    That library merges bytes, lowest rank first. A word's end is a byte sequence of its own that
    merges with the last byte before anything else does.
    """

    def __init__(self, definition: dict, dtype: np.dtype) -> None:
        import tiktoken

        model = definition["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        letters = _byte_of_letter()
        end = _END.encode() if self.suffix else b""
        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def add(token: bytes, number: int) -> None:
            if token not in ranks:
                ranks[token] = len(ids)
                ids.append(number)

        def as_bytes(token: str) -> bytes:
            ended = bool(self.suffix) and token.endswith(self.suffix)
            body = token.removesuffix(self.suffix) if ended else token
            return bytes(letters[letter] for letter in body) + end * ended

        vocab = model["vocab"]
        for letter, byte in sorted(letters.items(), key=lambda item: item[1]):
            add(bytes([byte]), vocab[letter])
        for size in range(2, len(end) + 1):
            add(end[:size], 0)
        if end:
            for letter, byte in letters.items():
                add(bytes([byte]) + end, vocab[letter + self.suffix])
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            add(as_bytes(left + right), vocab[left + right])
        self.ids = np.array(ids, dtype)
        self.words = _latin_words()
        self.encoding = tiktoken.Encoding(
            "latin", pat_str=f"[^{_END}]+{_END}" if end else _SPACED_WORDS, mergeable_ranks=ranks, special_tokens={}
        )

    @staticmethod
    def of(definition: dict, dtype: np.dtype) -> _LatinBpe | None:
        """None if the vocabulary is of another kind."""
        before, model = definition["pre_tokenizer"] or {}, definition["model"]
        plain = model["type"] == "BPE" and not any(
            model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        )
        spaced = (
            definition["normalizer"] is None
            and not model["end_of_word_suffix"]
            and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        )
        steps = [step["type"] for step in (definition["normalizer"] or {}).get("normalizers", [])]
        parts = before.get("pretokenizers", [{}])
        worded = (
            steps == ["NFC", "Replace", "Lowercase"]
            and bool(model["end_of_word_suffix"])
            and parts[0].get("pattern") == {"Regex": _WORDS}
            and [part["type"] for part in parts] == ["Split", "ByteLevel"]
        )
        return _LatinBpe(definition, dtype) if plain and (spaced or worded) else None

    def encode(self, text: str) -> bytes:
        if self.suffix:
            words = self.words.findall(text.lower())
            text = _END.join([*words, ""])
        return self.ids[self.encoding.encode_ordinary(text)].tobytes() if text else b""


class Encoder:
    """Ids of texts as the tokenizers library gives them, without special tokens added.

    Plain Latin texts go through ``_LatinBpe``. Any other text is cut before white space that
    follows something else: no token, and no rule of how words are told apart, reaches over such a
    place. Each piece is encoded by the library once and remembered.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        parsed = json.loads(self.tokenizer.to_str())
        added = parsed["added_tokens"]
        self.cuts = not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added
        )
        self.special = {t["id"]: t["content"].encode() for t in added}
        self._special_texts = [t["content"] for t in added]
        self._latin = _LatinBpe.of(parsed, self.dtype) if self.cuts else None
        self._known: dict[str, bytes] = {}
        self._known_bytes = 0

    def _simple(self, text: str) -> bool:
        return (
            self._latin is not None
            and (text.isascii() and _CONTROLS.search(text) is None or _LATIN.fullmatch(text) is not None)
            and not any(token in text for token in self._special_texts)
        )

    def _fresh(self, texts: Sequence[str]) -> Iterator[bytes]:
        for start in range(0, len(texts), _AT_ONCE):
            for found in self.tokenizer.encode_batch_fast(list(texts[start : start + _AT_ONCE]), add_special_tokens=False):
                yield np.array(found.ids, self.dtype).tobytes()

    def _pieces(self, text: str) -> list[str]:
        if not self.cuts or _ODD_BLANK.search(text):
            return [text] if text else []
        return _PIECE.findall(text)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text, as little-endian numbers of ``dtype``."""
        simple = [self._simple(text) for text in texts]
        others = iter(self._by_pieces([text for text, latin in zip(texts, simple) if not latin]))
        return [self._latin.encode(text) if latin else next(others) for text, latin in zip(texts, simple)]

    def _by_pieces(self, texts: Sequence[str]) -> list[bytes]:
        if self._known_bytes > KNOWN_BYTES:
            self._known, self._known_bytes = {}, 0
        known = self._known
        pieces = [self._pieces(text) for text in texts]
        missing = list(set(chain.from_iterable(pieces)).difference(known))
        extra: dict[str, bytes] = {}
        for piece, ids in zip(missing, self._fresh(missing)) if missing else ():
            if len(piece) <= LONGEST_PIECE and self._known_bytes <= KNOWN_BYTES:
                known[piece] = ids
                self._known_bytes += sys.getsizeof(piece) + sys.getsizeof(ids) + 100
            else:
                extra[piece] = ids
        return [b"".join(known[p] if p in known else extra[p] for p in found) for found in pieces]

    def byte_table(self) -> list[bytes]:
        """The bytes of each id of a byte-level vocabulary without word ends; unused ids have none."""
        letters = _byte_of_letter()
        table = [b""] * self.size
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if number in self.special:
                table[number] = self.special[number]
            else:
                table[number] = bytes(letters[letter] for letter in token)
        return table
