"""Words and lines of whole Arrow batches, by byte tables and numpy.

All separators used by the operators are ASCII, and in UTF-8 every byte of a
character outside ASCII is 0x80 or more. So working on bytes gives exactly the
words that a regular expression over code points would give.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def byte_table(is_word, lower: bool = True) -> bytes:
    """256 bytes: word bytes (A-Z lower-cased where asked), all others a space."""
    out = []
    for c in range(256):
        x = LOWER.get(c, c) if lower else c
        out.append(x if is_word(x) else 0x20)
    return bytes(out)


#: Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
ALNUM = byte_table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)
#: Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.
NONSPACE = byte_table(lambda c: c not in SPACES)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets (one more than texts) and bytes; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    whole = memoryview(data) if data is not None else memoryview(b"")
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def pieces(batches: Iterable[pa.RecordBatch], at: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``max_bytes`` bytes of the text in column ``at``, or of one longer text.

    numpy's arrays of words take a multiple of the text; this bounds it. What
    Arrow has freed goes back to the system after each batch, as idle workers
    stay beside the next stage's.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        offsets, _ = text_buffers(batch.column(at))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + max_bytes, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
        del batch
    pa.default_memory_pool().release_unused()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


@dataclass
class Words:
    """Words of a batch: their bytes without gaps, where each begins there, and where each text's words
    begin; ``starts`` and ``ends`` are the words' places in the bytes of all texts, one after another."""

    data: np.ndarray
    begins: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.begins) - 1

    def array(self) -> pa.Array:
        """The words as Arrow strings."""
        kind, string = (np.int32, pa.StringArray) if self.begins[-1] < 2**31 else (np.int64, pa.LargeStringArray)
        return string.from_buffers(len(self), pa.py_buffer(self.begins.astype(kind)), pa.py_buffer(self.data))

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins and ends there."""
        n = len(self)
        lengths = np.diff(self.begins)
        out = np.full(len(self.data) + n, 0x20, np.uint8)
        out[np.arange(len(self.data)) + np.repeat(np.arange(n), lengths)] = self.data
        begins = self.begins[:-1] + np.arange(n)
        return out.tobytes(), begins, begins + lengths


def words_of(texts: pa.Array, table: bytes) -> Words:
    """The words of every text under a byte table; a word never runs on into the next text."""
    offsets, raw = text_buffers(texts)
    data = np.frombuffer(bytes(raw).translate(table), np.uint8)
    is_word = data != 0x20
    before = np.zeros(len(data) + 1, bool)
    before[1:] = is_word
    after = before[1:].copy()
    after[:-1] = is_word[1:]
    if len(data):
        after[-1] = False
    edges = offsets[offsets < len(data)]
    before = before[:-1]
    before[edges] = False
    ends_at = offsets[(offsets > 0)] - 1
    after[ends_at] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    begins = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=begins[1:])
    return Words(data[is_word], begins, np.searchsorted(starts, offsets), starts, ends)
