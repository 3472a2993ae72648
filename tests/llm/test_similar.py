"""Groups of similar texts against all pairs."""

import random

import brute
import pytest
import texts

import corpus_pipeline
from slotwise.llm import near_copies, similar


def shingles(text):
    w = brute.words((text or "").translate(brute.SMALL))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def expected(docs):
    held = {i: shingles(t) for i, t in docs.items()}

    def linked(a, b):
        x, y = held[a], held[b]
        return x == y or 5 * len(x & y) >= 4 * len(x | y)

    return brute.components(held, linked)


def made():
    """Texts with 0 to 8 changed words each, chains of changes, and one crowd of variants."""
    rng = random.Random(11)
    docs = [t for _, t in texts.documents()]
    for base in range(12):
        words = texts.prose(500 + base, rng.choice([6, 30, 90, 240])).split()
        for _ in range(6):
            docs.append(" ".join(words))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(texts.WORDS)
    base = texts.prose(900, 60).split()
    for n in range(90):
        words = list(base)
        words[rng.randrange(60)] = f"own{n}"
        docs.append(" ".join(words[: rng.choice([60, 60, 52])]))
    return dict(enumerate(docs))


@pytest.mark.parametrize("crowd, block", [(64, 512), (2, 16), (1000, 512)])
def test_groups_against_all_pairs(spark, crowd, block):
    docs = made()
    frame = texts.frame(spark, [*docs.items()])
    got = similar.similar_groups(frame, crowd=crowd, block=block)
    want = expected(docs)
    assert {r.doc_id: r.component for r in got.collect()} == want
    assert 20 < len(set(want.values())) < len(docs) - 40


def test_links_of_blocks_are_exact():
    import pandas as pd

    rng = random.Random(3)
    sets = [rng.sample(range(30), 25) for _ in range(80)]
    rows = pd.DataFrame({"id": range(80), "shingles": sets})
    found = similar._links_of_blocks(rows).tolist()
    held = dict(enumerate(map(set, sets)))
    near = lambda a, b: 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b])
    pairs = {tuple(p) for p in found}
    joined = brute.components(held, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert joined == brute.components(held, near)


def test_the_stage_drops_what_is_similar_but_not_within_three_bits(spark):
    words = texts.prose(70, 120).split()
    other = list(words)
    other[20], other[60] = "changed", "twice"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, texts.prose(71, 120)), (None, " ".join(words))]
    assert 0.8 <= len(shingles(rows[0][1]) & shingles(rows[1][1])) / len(
        shingles(rows[0][1]) | shingles(rows[1][1])
    )
    fps = [brute.fingerprint(rows[n][1]) for n in (0, 1)]
    assert (fps[0] ^ fps[1]).bit_count() > near_copies.RADIUS
    frame = texts.frame(spark, rows)
    kept = dict(corpus_pipeline.STAGES)["near-copies"](spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]
