"""Repeated byte strings through a suffix order of many texts, built column by column.

The collection's Burrows-Wheeler transform and the common prefixes of neighbouring suffixes are built
without a suffix array: each round inserts one symbol for every text at once, which makes the suffix of
each text one longer. The new order follows from the old one by a stable sort of the inserted
symbols, and the common prefix of new neighbours is one more than the least between their places in
the old order, or nothing if their symbols differ. Order and prefixes lie in two files that each round
reads from front to back and writes anew. A string of the wanted length that occurs twice shows as
neighbouring suffixes with a common prefix of at least that length.

The texts are the stretches of a shard (see ``stretches``), at most two windows long, so rounds are few.
They are set so that their marks stand in one column. Equal windows have equal offsets from the mark,
so they begin in one column too, and only suffixes of one column need an order: a round keeps
that column's part of the transform and lets the one before go.

Defined results: a null text is empty; a text shorter than the length loses nothing; strings that
overlap in one text count, and what they cover is removed together; all places of a repeated
string go, so exact copies lose everything; a row without an id stays whole; rows that repeat
an id are a row each, judged by their own texts. Further columns are ignored.
"""

import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from slotwise.llm.frames import keyed_text
from slotwise.llm.stretches import Units, repeated_spans, told_apart, without_spans

LENGTH = 200
#: Bytes whose hash marks a window; windows of one mark are compared.
GRAM = 48


class Columns:
    """The files of a construction: texts in the order of their suffixes, and common prefixes.

    Each round writes over the one before, as both always have a number for every text.
    """

    def __init__(self, folder: str):
        self.order = open(Path(folder, "order"), "w+b", buffering=0)
        self.prefixes = open(Path(folder, "prefixes"), "w+b", buffering=0)

    def __enter__(self) -> "Columns":
        return self

    def __exit__(self, *_) -> None:
        self.order.close()
        self.prefixes.close()

    def write(self, order: np.ndarray, prefixes: np.ndarray) -> None:
        for file, values in ((self.order, order), (self.prefixes, prefixes)):
            file.seek(0)
            file.write(values.data)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        self.order.seek(0)
        self.prefixes.seek(0)
        return np.fromfile(self.order, np.int32), np.fromfile(self.prefixes, np.uint16)


def aligned(texts: list[bytes], gaps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as rows of a table, each ending ``gap`` columns before the last; and where each begins.

    0 stands where a row has no byte; no byte of a text is 0 there, as bytes are numbered from 1. All
    256 cannot occur in UTF-8.
    """
    sizes = np.array([len(t) for t in texts])
    back = np.array(gaps)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    used = np.zeros(256, bool)
    used[raw] = True
    width = int((sizes + back).max(initial=0))
    table = np.zeros((len(texts), width), np.uint8)
    begins = width - back - sizes
    at = np.arange(width)
    inside = (at >= begins[:, None]) & (at < (begins + sizes)[:, None])
    table[inside] = np.cumsum(used).astype(np.uint8)[raw]
    return table, begins


def insert(symbols: np.ndarray, order: np.ndarray, prefixes: np.ndarray):
    """Order and common prefixes after one more symbol before every suffix.

    ``symbols`` are those of the texts in their present order, which is the transform's part for
    this column.
    """
    sort = np.argsort(symbols, kind="stable")
    kind = symbols[sort]
    same = np.flatnonzero((kind[1:] == kind[:-1]) & (kind[1:] > 0)) + 1
    fresh = np.zeros(len(order), np.uint16)
    if len(same):
        # of each neighbour pair, the least prefix between their old places
        edges = np.stack([sort[same - 1] + 1, sort[same] + 1], axis=1).ravel()
        fresh[same] = np.minimum.reduceat(np.append(prefixes, prefixes[-1:]), edges)[::2] + 1
    return order[sort], fresh


def shared_windows(
    texts: list[bytes], gaps: list[int], twice: list[bool], length: int
) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes occur anywhere else.

    Texts that stand for several places take part twice.
    """
    again = np.flatnonzero(twice)
    table, begins = aligned(
        texts + [texts[i] for i in again], list(gaps) + [gaps[i] for i in again]
    )
    count, width = table.shape
    table = np.ascontiguousarray(table.T)
    found = np.zeros((width, count), bool)
    with tempfile.TemporaryDirectory() as folder, Columns(folder) as files:
        files.write(np.arange(count, dtype=np.int32), np.zeros(count, np.uint16))
        for column in range(width - 1, -1, -1):
            order, prefixes = files.read()
            order, prefixes = insert(table[column][order], order, prefixes)
            near = prefixes >= length
            near[:-1] |= near[1:]
            found[column][order[near]] = True
            files.write(order, prefixes)
    return [
        found[begin : begin + max(0, len(t) - length + 1), i]
        for i, (t, begin) in enumerate(zip(texts, begins[: len(texts)].tolist(), strict=True))
    ]


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digests: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, n_spans and kept (text, or its SHA-256) of every document,
    without each byte in a string of ``length`` bytes that also begins elsewhere."""
    units = Units(length, gram, words=False)
    rows, restored = told_apart(keyed_text(docs, doc_id, text))
    found = repeated_spans(rows, units, shared_windows)
    return restored(without_spans(rows, found, units, digests)).withColumnRenamed("id", "doc_id")
