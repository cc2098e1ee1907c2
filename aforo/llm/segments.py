"""Splitting texts where no token can cross, so that a library's encodings of the parts join to that of the whole.

For a byte-level BPE whose pre-tokenizer binds a space to the word after it, and for a piece model none of whose
pieces has a word-start mark behind another character, a lone space between two other characters always starts a token.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

_MARK = "▁"
_SPACES = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_CUT = re.compile(rf"(?<=[^\s{_MARK}]) (?=[^\s{_MARK}])")


def split_at_spaces(text: str) -> list[str]:
    """Parts of the text without the lone spaces between them; ' '.join gives the text back."""
    return text.split(" ") if only_lone_spaces(text) else _CUT.split(text)


def only_lone_spaces(text: str) -> bool:
    """Whether each space stands between two other characters: single searches, far faster than a pattern."""
    if text[:1] == " " or text[-1:] == " " or _MARK in text:
        return False
    return not any(x in text and (" " + x in text or x + " " in text) for x in _SPACES)


class BoundedCache(dict):
    """Encodings of parts seen before, emptied when its keys have more than max_chars characters."""

    def __init__(self, max_chars: int = 12_000_000, max_entries: int = 700_000):
        super().__init__()
        self.max_chars, self.max_entries, self.chars = max_chars, max_entries, 0

    def add(self, parts: list[str], encodings: list) -> None:
        self.update(zip(parts, encodings))
        self.chars += sum(map(len, parts))

    def trim(self) -> None:
        if self.chars > self.max_chars or len(self) > self.max_entries:
            self.clear()
            self.chars = 0


def byte_batches(sizes: Iterable[int], max_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive (start, stop) ranges of texts of these sizes with about equal sums; a larger text has a range of its own."""
    start = held = stop = 0
    for stop, size in enumerate(sizes, 1):
        if held and held + size > max_bytes:
            yield start, stop - 1
            start, held = stop - 1, 0
        held += size
    if start < stop:
        yield start, stop


def utf8_sizes(texts: list[str]) -> list[int]:
    return [len(t) if t.isascii() else len(t.encode()) for t in texts]


def text_batches(texts: pa.Array, max_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """byte_batches of the texts' UTF-8 lengths."""
    yield from byte_batches(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), max_bytes)
