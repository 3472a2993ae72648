"""Substring dedup where rows repeat an id, with one text or with several."""

import brute
import pytest
import texts

from slotwise.llm import suffix_columns, word_index

LONG, OTHER = texts.prose(1, 60), texts.prose(2, 60)
ROWS = [
    (1, LONG), (1, OTHER + " " + texts.prose(3, 40)), (1, None), (2, texts.prose(4, 30) + " " + OTHER),
    (2, texts.prose(5, 50)), (3, texts.prose(6, 50)), (3, texts.prose(6, 50)), (4, texts.prose(7, 50)),
    (-5, "short"), (-5, texts.prose(8, 20) + " " + LONG),
]


@pytest.mark.parametrize("by_words", [True, False])
def test_rows_of_one_id_are_judged_by_their_own_texts(spark, by_words):
    docs = texts.frame(spark, ROWS)
    if by_words:
        got = word_index.without_repeats(docs, words=8, gram=3)
        units, length = {n: brute.words(t) for n, (_, t) in enumerate(ROWS)}, 8
    else:
        got = suffix_columns.without_repeats(docs, length=40, gram=12, digests=True)
        units, length = {n: (t or "").encode() for n, (_, t) in enumerate(ROWS)}, 40
    gone = brute.repeated(units, length)
    expected = []
    for n, u in units.items():
        kept = [x for x, g in zip(u, gone[n], strict=True) if not g]
        value = " ".join(kept) if by_words else brute.sha(bytes(kept))
        expected.append((ROWS[n][0], len(u), sum(gone[n]), brute.runs(gone[n]), value))
    found = got.select("doc_id", "n_units", "n_removed", "n_spans", "kept").collect()
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert any(e[2] and e[2] < e[1] for e in expected)
