"""Repeated runs of words by backward search in a compressed index.

A shard's texts are put into one FM-index: the Burrows-Wheeler transform of their words in a wavelet
matrix, whose levels are bit vectors with a count at each 64th bit. Every text of the shard is then
streamed through the index: from its end backwards, the search narrows the rows that begin with
the run read so far. While at least two rows remain, the run occurs twice; the number of steps is the
matching statistic of that end. Runs that reach the threshold are intervals that are reported.

Defined results: a null text has no words; a text of fewer words than the threshold loses nothing;
runs that overlap in one text count, and what they cover is removed together; all places of a
repeated run go, so exact copies lose everything; a row without an id stays whole; rows that repeat
an id are a row each, judged by their own texts. Words are compared as they are. Further columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slotwise.llm import spans
from slotwise.llm.frames import keyed_text
from slotwise.llm.stretches import Units, repeated_spans, told_apart, without_spans

WORDS = 35
#: Words whose hash marks a window; windows of one mark are compared.
GRAM = 12


class WaveletMatrix:
    """Occurrences of any symbol before any place, in a bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for bit in range(bits - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            held = np.zeros(-(-(len(ones) + 1) // 64) * 64, np.uint8)
            held[: len(ones)] = ones
            packed = np.packbits(held, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((packed, before, int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where rows before ``at`` with the symbol end when all rows are sorted by symbol."""
        for level, (packed, before, zeros) in enumerate(self.levels):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(packed[block] & mask)
            right = (symbol >> (self.bits - 1 - level)) & 1 == 1
            at = np.where(right, zeros + ones, at - ones)
        return at


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): equal keys have one rank."""
    order = np.argsort(key)  # equal keys may come in any order
    held = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
    return order, rank


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in order of their first ``length`` symbols at least, by doubling.

    The first round takes as many symbols as fit one number.
    """
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    done = max(1, min(62 // bits, length))
    key = np.zeros(len(symbols), np.int64)
    for i in range(done):
        key <<= bits
        key[: len(key) - i] |= symbols[i:]
    order, rank = _ranked(key)
    while done < length and len(rank) > done:
        second = np.zeros(len(rank), np.int64)
        second[:-done] = rank[done:] + 1
        order, rank = _ranked(rank * (len(rank) + 1) + second)
        done *= 2
    return order


class FmIndex:
    """A searchable index of one row of symbols; symbol 0 stands between texts.

    A place may count for several, by its weight.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, length: int):
        order = suffix_order(symbols, length)
        self.weight_before = np.concatenate([[0], np.cumsum(weights[order])])
        bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.matrix = WaveletMatrix(symbols[order - 1], bits)
        counts = np.bincount(symbols, minlength=int(symbols.max(initial=0)) + 1)
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        self.base = self.matrix.place(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    def narrow(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Rows that begin with the symbol and go on as the given rows do."""
        both = np.concatenate([symbol, symbol])
        found = self.matrix.place(both, np.concatenate([low, high])) + (self.begin[both] - self.base[both])
        return found[: len(symbol)], found[len(symbol) :]


def repeated_runs(index: FmIndex, symbols: np.ndarray, begins, ends, length: int):
    """(first, last): places of windows of ``length`` symbols that occur at least twice.

    Windows are judged in stretches, at first all those of a text. A search goes backwards from the end of one
    window for as long as rows of a weight of two begin with the run read so far; that is the
    matching statistic of this end. If it reaches the window's begin, all windows within the run are
    reported. If not, the run and the symbol before it occur once, and so does every window that
    holds them. What is left before and behind is searched again. All stretches go on at once, at first from
    their last window, as a text may repeat whole, then from the middle.
    """
    first, last = begins, ends - length
    window = last
    while True:
        open_ = first <= last
        first, last, window = first[open_], last[open_], window[open_]
        if not len(first):
            return
        end = window + length
        reach, going = end.copy(), np.arange(len(first))
        low, high = np.zeros(len(first), np.int64), np.full(len(first), len(symbols), np.int64)
        while len(going):
            low, high = index.narrow(symbols[reach[going] - 1], low, high)
            more = index.weight_before[high] - index.weight_before[low] >= 2
            going, low, high = going[more], low[more], high[more]
            reach[going] -= 1
            inside = reach[going] > first[going]
            going, low, high = going[inside], low[inside], high[inside]
        hit = reach <= window
        yield reach[hit], window[hit]
        before, behind = np.minimum(reach, window) - 1, np.maximum(reach, window + 1)
        first, last = np.concatenate([first, behind]), np.concatenate([before, last])
        window = (first + last) // 2


def shared_windows(
    texts: list[bytes], gaps: list[int], twice: list[bool], length: int
) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` words occur anywhere else.

    Those that stand for several places are in the index once, with a weight of two.
    """
    column = pa.array(texts, pa.binary()).cast(pa.string())
    _, words, hashes = spans.words_of(column, spans.NOT_BLANK)
    number = np.unique(hashes, return_inverse=True)[1] + 1
    counts = np.diff(words.bounds)
    # each text behind a 0
    text = np.repeat(np.arange(len(texts)), counts)
    symbols = np.zeros(len(number) + len(texts) + 1, np.int64)
    weights = np.ones(len(symbols), np.int64)
    symbols[np.arange(len(number)) + text + 1] = number
    weights[np.arange(len(number)) + text + 1] += np.array(twice, np.int64)[text]
    begins = words.bounds[:-1] + np.arange(len(texts)) + 1
    ends = begins + counts
    changes = np.zeros(len(symbols) + 1, np.int32)
    index = FmIndex(symbols, weights, length)
    for first, last in repeated_runs(index, symbols, begins, ends, length):
        np.add.at(changes, first, 1)
        np.add.at(changes, last + 1, -1)
    reached = np.cumsum(changes) > 0
    windows = np.maximum(counts - length + 1, 0)
    return [reached[a : a + n] for a, n in zip(begins.tolist(), windows.tolist(), strict=True)]


def without_repeats(
    docs: DataFrame, words: int = WORDS, gram: int = GRAM, digests: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_units (words), n_removed, n_spans and kept (text, or its SHA-256) of every document,
    without each word in a run of ``words`` words that also begins elsewhere."""
    units = Units(words, gram, words=True)
    rows, restored = told_apart(keyed_text(docs, doc_id, text))
    found = repeated_spans(rows, units, shared_windows)
    return restored(without_spans(rows, found, units, digests)).withColumnRenamed("id", "doc_id")
