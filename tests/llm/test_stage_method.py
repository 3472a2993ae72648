"""The near-copies stage goes by fingerprints and vantage-point trees before anything else."""

import random

import texts

from slotwise.llm import near_copies, similar, sketches
from slotwise.llm.frames import keyed_text


def test_trees_over_blocks_join_all_within_the_radius(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(60):
        fps.append(rng.getrandbits(64))
        for _ in range(6):
            fp = fps[-1]
            for bit in rng.sample(range(64), rng.randint(1, 9)):
                fp ^= 1 << bit
            fps.append(fp)
    fps = sorted({*fps})
    rows = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps]
    frame = spark.createDataFrame(rows, "fp bigint")
    found = near_copies.near_links(frame, shard=32, sample=128, radius=7, blocks=4).collect()
    group = {fp: fp for fp in fps}

    def top(fp):
        while group[fp] != fp:
            fp = group[fp]
        return fp

    for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in found):
        group[top(a)] = top(b)
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 7]
    assert len(near) > 150
    assert all(top(a) == top(b) for a, b in near)
    assert len({top(fp) for fp in fps}) >= 60


def test_fingerprints_join_near_copies_without_the_lists(spark, monkeypatch):
    words = texts.prose(70, 300).split()
    other = [*words]
    other[20] = "changed"
    frame = texts.frame(spark, [(1, " ".join(words)), (2, " ".join(other)), (3, texts.prose(71, 300))])
    fps = [r.fp for r in near_copies.fingerprint_rows(keyed_text(frame), similar.SHINGLE).collect()]
    assert 0 < (fps[0] % (1 << 64) ^ fps[1] % (1 << 64)).bit_count() <= similar.RADIUS
    plain = sketches.leading_members
    monkeypatch.setattr(sketches, "leading_members", lambda own: plain(own).where("false"))
    got = {r.doc_id: r.component for r in similar.similar_groups(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
