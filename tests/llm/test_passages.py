"""Line dedup of passages that fill fewer lines than the window, against loops."""

import random
from collections import defaultdict

import brute
import texts

import corpus_pipeline
from slotwise.llm import lines


def without_passages(docs, words, size=3):
    seen, gone = set(), defaultdict(set)
    for i in sorted(docs):
        pieces = (docs[i] or "").split("\n")
        held = [n for n, x in enumerate(pieces) if brute.BLANK_WORD.search(x)]
        for k in range(len(held)):
            for m in range(1, size + 1):
                run = held[k : k + m]
                told = sum(len(brute.words(pieces[n])) for n in run)
                if len(run) < m or (m < size and told < words and len(held) != m):
                    continue
                window = tuple(pieces[n] for n in run)
                if window in seen:
                    gone[i] |= set(run)
                seen.add(window)
    return {
        i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        for i, t in docs.items()
    }


def made():
    rng = random.Random(5)
    pool = [texts.prose(n, size, 1000) for n, size in enumerate([4, 9, 24, 26, 49, 50, 51, 80])]
    docs = [t for _, t in texts.documents()]
    docs += ["\n".join(rng.choices([*pool, "", " "], k=rng.randint(1, 5))) for _ in range(60)]
    return dict(enumerate(docs))


def test_passages_against_loops(spark):
    docs = made()
    got = lines.drop_repeated_lines(texts.frame(spark, [*docs.items()]), words=50)
    want = without_passages(docs, 50)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert want != brute.without_lines(docs)


def test_the_stage_drops_long_passages_of_one_or_two_lines(spark):
    long, half, other = (texts.prose(n, size, 1000) for n, size in ((1, 60), (2, 30), (3, 30)))
    rows = [
        (1, f"a\n{long}\nb\n{half}\n{other}\nc"), (2, f"d\n{long}\ne"), (3, f"f\n{half}\n{other}\ng"),
        (4, f"{half}\nh"), (5, long), (6, "few words"), (7, "few words"), (8, f"few words\n{half}"),
    ]
    stage = dict(corpus_pipeline.STAGES)["lines"]
    got = {r.doc_id: r.text for r in stage(spark, texts.frame(spark, rows), "").collect()}
    assert got == {
        **dict(rows), 2: "d\ne", 3: "f\ng", 5: "", 7: "",
    }
