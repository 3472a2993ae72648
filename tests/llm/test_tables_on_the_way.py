"""What near-copies jobs leave on disk on their way, and rounds that change no result."""

import os

import pytest
import texts

from slotwise.llm import components, similar
from slotwise.llm.frames import scratch_path
from slotwise.llm.sketches import sketch_groups
from test_similar import expected, made


def tables(spark):
    root = os.path.dirname(scratch_path(spark, "x"))
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_components_keep_their_last_round_only(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(40)], "a bigint, b bigint")
    before = tables(spark)
    found = components.components(edges)
    assert len(tables(spark) - before) == 1
    assert {(r.node, r.root) for r in found.collect()} == {(n, 0) for n in range(41)}


@pytest.mark.parametrize("rounds, likely", [(0, similar.by_fingerprints), (1, None)])
def test_the_number_of_rounds_changes_no_group(spark, rounds, likely):
    docs = made()
    frame = texts.frame(spark, [*docs.items()])
    found = sketch_groups(frame, shingle=similar.SHINGLE, wordless=True, crowd=8, block=16, likely=likely, rounds=rounds)
    assert {r.doc_id: r.component for r in found.collect()} == expected(docs)
