"""Words of whole texts, cut from their UTF-8 bytes with numpy.

A table says of each byte whether it belongs to a word, to a gap or to a break
between pieces. Only ASCII bytes may be gaps or breaks, so no character is cut.
Texts are looked at in groups of a bounded number of bytes; a longer text is
cut behind a break (or a gap, where words alone matter), never inside a piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, GAP, BREAK = 0, 1, 2
GROUP_BYTES = 5 << 20


def byte_kinds(gaps: Iterable[int], breaks: Iterable[int] = ()) -> np.ndarray:
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


LOWER = _lower()


@dataclass
class Words:
    """Words of one group, in order: a binary array, the row of each in the batch, and a number that changes at each break."""

    text: pa.Array
    row: np.ndarray
    piece: np.ndarray


def _cuts(data: np.ndarray, begin: int, end: int, kinds: np.ndarray, cut_at: int, size: int) -> Iterator[int]:
    """Places behind which a long text may be cut, about ``size`` bytes apart."""
    at = begin
    while end - at > size:
        look = at + size
        while look < end:
            found = np.flatnonzero(kinds[data[look : look + size]] >= cut_at)
            if len(found):
                break
            look += size
        if look >= end:
            return
        at = look + int(found[0]) + 1
        if at < end:
            yield at


def words_of(texts: pa.Array, kinds: np.ndarray, cut_at: int = BREAK, size: int = GROUP_BYTES) -> Iterator[Words]:
    """Lower-cased (A-Z only) words of each text, group by group; null texts have none.

    A text that has no byte of kind ``cut_at`` or more for ``size`` bytes is
    held as a whole until the next one.
    """
    texts = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begins, rows = [], []
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if begin == end:
            continue
        parts = [begin, *_cuts(data, begin, end, kinds, cut_at, size)] if end - begin > size else [begin]
        begins += parts
        rows += [row] * len(parts)
    last = int(offsets[-1]) if len(offsets) else 0
    starts, row_of = np.array(begins, np.int64), np.array(rows, np.int64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1)
        until = int(starts[stop]) if stop < len(starts) else last
        if stop == len(starts) - 1 and last - int(starts[at]) <= size:
            stop, until = len(starts), last
        found = _group(data[int(starts[at]) : until], starts[at:stop] - starts[at], row_of[at:stop], kinds)
        if found is not None:
            yield found
        at = stop


def _group(raw: np.ndarray, parts: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> Words | None:
    raw = LOWER[raw]
    kind = kinds[raw]
    inside = kind == WORD
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[parts] = inside[parts]
    begin = np.flatnonzero(first)
    if not len(begin):
        return None
    final = inside.copy()
    final[:-1] &= ~inside[1:]
    final[parts[1:] - 1] = inside[parts[1:] - 1]
    end = np.flatnonzero(final) + 1
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    packed = np.ascontiguousarray(raw[inside])
    text = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    part = np.searchsorted(parts, begin, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), begin) + part
    return Words(text, rows[part], piece)


def distinct(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and the place of each word among them."""
    coded = pc.dictionary_encode(words)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
