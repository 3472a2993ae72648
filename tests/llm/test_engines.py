"""The parts that work inside one task, against loops."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from slotwise.llm import near_copies, spans, suffix_columns, word_index


@pytest.mark.parametrize("seed", range(6))
def test_every_window_is_in_one_stretch_and_equal_windows_agree(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab c", k=rng.randint(0, 90))) for _ in range(20)]
    raw, offsets = spans.text_bytes(pa.array(texts))
    size, gram = 12, 5
    places, seen = {}, 0
    for s in spans.winnow(spans.BYTE_VALUES[raw], offsets, size, gram):
        for text, mark, first, last, place in zip(s.text, s.mark, s.first, s.last, s.place, strict=True):
            for at in range(first, last + 1):
                window = texts[text][at : at + size]
                assert places.setdefault(window, (mark, place - at)) == (mark, place - at)
                seen += 1
    assert seen == sum(max(0, len(t) - size + 1) for t in texts)


def test_a_long_text_is_winnowed_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choices("abcd", k=5000))
    raw, offsets = spans.text_bytes(pa.array(["x" * 30, text, text]))

    def marks():
        return {
            (t, at): m
            for s in spans.winnow(spans.BYTE_VALUES[raw], offsets, 50, 10)
            for t, m, a, b in zip(s.text, s.mark, s.first, s.last, strict=True)
            for at in range(a, b + 1)
        }

    whole = marks()
    monkeypatch.setattr(spans, "PIECE", 700)
    assert marks() == whole
    assert len(whole) == 2 * 4951


def test_words_do_not_cross_texts():
    _, words, hashes = spans.words_of(pa.array(["ab", "cd ab", None, " ", "ab"]), spans.NOT_BLANK)
    assert np.diff(words.bounds).tolist() == [1, 2, 0, 0, 1]
    assert hashes[0] == hashes[2] == hashes[3] != hashes[1]


@pytest.mark.parametrize("seed", range(40))
def test_word_index_against_loops(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 25))).encode() for _ in range(12)]
    twice = [rng.random() < 0.2 for _ in texts]
    length = rng.randint(1, 7)
    held = texts + [t for t, again in zip(texts, twice, strict=True) if again]
    expected = brute.repeated({n: t.split() for n, t in enumerate(held)}, length)
    got = word_index.shared_windows(texts, [0] * 12, twice, length)
    for n, hit in enumerate(got):
        cover = [False] * len(texts[n].split())
        for k in np.flatnonzero(hit):
            cover[k : k + length] = [True] * length
        assert cover == expected[n]


def test_a_short_run_rules_out_the_windows_that_hold_it(monkeypatch):
    """Texts that share twelve words in surroundings of their own, and one that goes on as another does."""
    steps, narrow = [], word_index.FmIndex.narrow

    def counted(*given):
        steps.append(1)
        return narrow(*given)

    monkeypatch.setattr(word_index.FmIndex, "narrow", counted)
    shared = [f"m{k}" for k in range(12)]
    own = [[f"{side}{t}x{k}" for k in range(23)] for t in range(20) for side in "ab"]
    words = [own[2 * t] + shared + own[2 * t + 1] for t in range(20)]
    words.append([*own[0][5:], *shared, *own[1][:9], "z"])
    got = word_index.shared_windows([" ".join(w).encode() for w in words], [0] * 21, [False] * 21, 35)
    assert np.flatnonzero(got[0]).tolist() == [5, 6, 7, 8, 9]
    assert np.flatnonzero(got[20]).tolist() == [0, 1, 2, 3, 4]
    assert not any(hit.any() for hit in got[1:20])
    # 273 when each window that does not repeat was searched by itself
    assert len(steps) < 200


@pytest.mark.parametrize("seed", range(40))
def test_suffix_columns_against_loops(seed):
    """Texts that share a mark at one place, as the stretches of a shard do."""
    rng = random.Random(seed)
    length, mark = 12, "mmmm"
    texts, gaps = [], []
    for _ in range(15):
        left, right = ("".join(rng.choices("ab", k=rng.randint(0, 8))) for _ in range(2))
        text = left + mark + right
        if len(text) >= length:
            texts.append(text.encode())
            gaps.append(len(left) - (len(text) - length))
    if min(gaps, default=0) < 0:
        texts = [t[: len(t) + min(0, g)] for t, g in zip(texts, gaps, strict=True)]
        pairs = [(t, max(0, g)) for t, g in zip(texts, gaps, strict=True) if len(t) >= length]
        texts, gaps = [p[0] for p in pairs], [p[1] for p in pairs]
    twice = [rng.random() < 0.2 for _ in texts]
    got = suffix_columns.shared_windows(texts, gaps, twice, length)
    seen = {}
    for t, again in zip(texts, twice, strict=True):
        for k in range(len(t) - length + 1):
            key = (t[k : k + length], t.index(b"mmmm") - k)
            seen[key] = seen.get(key, 0) + 1 + again
    for t, hit in zip(texts, got, strict=True):
        assert hit.tolist() == [
            seen[t[k : k + length], t.index(b"mmmm") - k] > 1 for k in range(len(t) - length + 1)
        ]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("clustered", [False, True])
def test_vantage_links_join_all_that_is_near(seed, clustered):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 63, 40 if clustered else 900, np.uint64)
    near = [fps]
    for _ in range(40 if clustered else 1):
        flips = np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
        near.append(near[-1] ^ flips)
    fps = np.unique(np.concatenate(near))
    found = [
        pair
        for half in (0, 1)
        for part in near_copies.links(fps, near_copies.half_of(fps, half), 1, 3)
        for pair in part.tolist()
    ]
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        assert (a ^ b).bit_count() <= 64
        parent[find(a)] = find(b)
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for i, j in zip(*np.nonzero(apart <= 3), strict=True):
        assert find(int(fps[i])) == find(int(fps[j]))
    assert len(found) < 20 * len(fps)


def test_top_of_the_trees_keeps_near_pairs_together():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 32, 3000, np.uint64).astype(np.uint32)
    tree = near_copies.lay_out(points, 1.0, 1, 200)
    shards = {}
    for leaf, at in near_copies.deal(points, tree, 1):
        for n in at:
            shards.setdefault(int(n), set()).add(leaf)
    assert len({leaf for held in shards.values() for leaf in held}) > 8
    moved = points ^ (np.uint32(1) << rng.integers(0, 32, 3000).astype(np.uint32))
    for leaf, at in near_copies.deal(moved, tree, 1):
        for n in at:
            shards[int(n)].add(-leaf)
    for held in shards.values():
        assert {s for s in held if s > 0} & {-s for s in held if s < 0}
