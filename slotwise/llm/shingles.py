"""Sets of word shingles of a batch of texts, and exact comparison of a few of them at once."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from slotwise.llm import spans

#: Bytes of text whose shingles are held at once.
AT_ONCE = 1 << 20


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash): the distinct shingles of each text of a batch, in order of both."""
    raw, offsets = spans.text_bytes(column)
    raw = spans.LOWER[raw]
    words = spans.find_words(raw, offsets, spans.NOT_BLANK)
    hashes = spans.range_hashes(spans.BYTE_VALUES[raw], words.starts, words.ends)
    counts = np.diff(words.bounds)
    number = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), number)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = words.bounds[:-1][text] + inner
    found = spans.range_hashes(hashes, first, first + np.minimum(counts[text], shingle))
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    return text[new], found[new]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(batch.num_rows * AT_ONCE // max(batch.nbytes, AT_ONCE)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def links_of_blocks(rows: pd.DataFrame) -> np.ndarray:
    """A forest of links (a, b) that joins all similar texts of two blocks (of one, if alone)."""
    ids = rows["id"].to_numpy()
    held = [np.asarray(s, np.int64) for s in rows["shingles"]]
    n = np.array([len(s) for s in held])
    values, code, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(len(held)), n)
    # what one text alone holds is in no intersection
    column = np.cumsum(times > 1) - 1
    keep = times[code] > 1
    shared = np.zeros((len(held), len(held)), np.float32)
    text, place = text[keep], column[code[keep]]
    order = np.argsort(place, kind="stable")
    text, place = text[order], place[order]
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, [lo, lo + 4096])
        part = np.zeros((len(held), 4096), np.float32)
        part[text[a:b], place[a:b] - lo] = 1
        shared += part @ part.T
    near = 9 * shared.astype(np.int64) >= 4 * (n[:, None] + n[None, :])
    np.fill_diagonal(near, True)
    label = np.arange(len(held))
    while True:
        new = np.where(near, label[None, :], len(held)).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(held)))
    return np.stack([ids[label[moved]], ids[moved]], axis=1)
