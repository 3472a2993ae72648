"""Words, rolling hashes and winnowing over batches of text, in numpy.

Everything here works on one Arrow batch inside a task. Texts are cut into pieces whose windows
do not overlap, so a text of any length is handled within a fixed amount of memory.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Windows of one piece of a text, or of several short texts handled together.
PIECE = 1 << 18
#: Low bits of a packed order key that hold the position; a piece is always shorter.
POSITION_BITS = np.uint64(23)
_ODD = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; equal values stay equal."""
    v = values ^ (values >> np.uint64(30))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v = v * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


#: A 64-bit value for each byte value, the same in every process.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def _power(size: int, base: int = 0xD1342543DE82EF95) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``size`` of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < size:
        size = 1 << (size - 1).bit_length()
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.cumprod(up), np.cumprod(down))
    return have


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice ``values[start:end]``; equal slices have equal hashes."""
    up, down = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(_ODD))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` values."""
    count = max(0, len(values) - width + 1)
    if width <= 16:
        total = np.zeros(count, np.uint64)
        for i in range(width):
            total = total * np.uint64(0xD1342543DE82EF95) + values[i : i + count]
        return mix(total)
    starts = np.arange(count)
    return range_hashes(values, starts, starts + width)


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the least, the first of equals.

    Only the high bits of a value take part, so that the place fits beside them; equal runs
    choose the same place whatever surrounds them.
    """
    keys = ((values >> POSITION_BITS) << POSITION_BITS) | np.arange(len(values), dtype=np.uint64)
    count, span = len(values) - width + 1, 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    best = keys[:count] if not rest else np.minimum(keys[:count], keys[rest : rest + count])
    return (best & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch and where each begins and ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of consecutive texts: their byte ranges, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def find_words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Longest runs of word bytes; a run never crosses from one text into the next."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = is_word[raw]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edge] = inside[edge + 1]
    last[edge - 1] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def byte_table(pattern_bytes: Iterator[int]) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(pattern_bytes)] = True
    return held


#: Everything but the six blanks of ``[^\\x20\\x09-\\x0D]``.
NOT_BLANK = ~byte_table([0x20, *range(0x09, 0x0E)])
#: ASCII digits and small letters, and all of UTF-8 beyond ASCII.
LETTERS_DIGITS = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def groups(bounds: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive texts whose items together are about ``most``; a longer text stands alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Selected:
    """Winnowed fingerprints: consecutive windows of a text that chose the same place."""

    text: np.ndarray  # which text of the batch
    mark: np.ndarray  # hash at the chosen place
    first: np.ndarray  # first window, as a place in the text
    last: np.ndarray  # last window
    place: np.ndarray  # the chosen place itself, as a place in the text
    whole: np.ndarray  # hash of all items from the first window's begin to the last one's end


def winnow(
    values: np.ndarray, bounds: np.ndarray, window: int, gram: int, wholes: bool = False
) -> Iterator[Selected]:
    """The fingerprints of all windows of ``window`` items, each window in exactly one of them.

    A window's fingerprint is the least hash of its runs of ``gram`` items. It depends on the
    window alone, so equal windows anywhere have the same one at the same place within them.
    ``bounds`` says where each text begins and ends. Nothing crosses texts. ``wholes`` asks for the
    hash of each stretch of windows.
    """
    lead = window - gram + 1
    for lo, hi in groups(bounds):
        begin, end = bounds[lo], bounds[hi]
        for at in range(begin, end, PIECE):
            stop = end if end - begin <= 2 * PIECE else min(end, at + PIECE + window - 1)
            part = values[at:stop]
            if len(part) >= window:
                marks = rolling(part, gram)
                places = minima(marks, lead)
                starts = np.arange(at, at + len(places))
                owner = np.searchsorted(bounds[lo : hi + 1], starts, "right") - 1 + lo
                # a window ends in the text it begins in
                good = starts + window <= bounds[owner + 1]
                owner, starts, places = owner[good], starts[good], places[good]
                if len(starts):
                    new = np.ones(len(starts), bool)
                    new[1:] = (places[1:] != places[:-1]) | (owner[1:] != owner[:-1])
                    # the same place is chosen by one stretch of windows only
                    heads = np.flatnonzero(new)
                    tails = np.append(heads[1:], len(starts)) - 1
                    base = bounds[owner[heads]]
                    whole = base
                    if wholes:
                        whole = range_hashes(part, starts[heads] - at, starts[tails] - at + window)
                    yield Selected(
                        owner[heads],
                        marks[places[heads]],
                        starts[heads] - base,
                        starts[tails] - base,
                        places[heads] + at - base,
                        whole,
                    )
            if stop == end:
                break


def words_of(column: pa.Array, is_word: np.ndarray, lower: bool = False):
    """(bytes, words, word hashes) of a batch of texts."""
    raw, offsets = text_bytes(column)
    if lower:
        raw = LOWER[raw]
    words = find_words(raw, offsets, is_word)
    hashes = np.empty(len(words.starts), np.uint64)
    for lo, hi in groups(offsets):
        a, b = words.bounds[lo], words.bounds[hi]
        base = offsets[lo]
        values = BYTE_VALUES[raw[base : offsets[hi]]]
        hashes[a:b] = range_hashes(values, words.starts[a:b] - base, words.ends[a:b] - base)
    return raw, words, hashes


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as disjoint ranges in order; ranges that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    head = np.ones(len(starts), bool)
    head[1:] = starts[1:] > ends[:-1]
    heads = np.flatnonzero(head)
    return starts[heads], ends[np.append(heads[1:], len(starts)) - 1]
