"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The stage of the pipeline that keeps one document of each group of near copies. SimHash fingerprints of
five-word shingles that differ in up to ``RADIUS`` bits are met through the vantage-point trees of
:mod:`slotwise.llm.near_copies`, over four blocks of 16 bits in which such a pair differs at most once
somewhere; whole sets confirm them. Texts that are alike to 0.8 may lie further apart, and no number of bits
reaches them all, so the sketches of :mod:`slotwise.llm.sketches` then go on from the groups found
and join what the fingerprints leave apart.

Defined results: words are lower-cased (ASCII) and lie between blanks; a text of fewer words than a
shingle is one shingle; null and wordless texts are one group; a row without an id is in no group;
rows that repeat an id are one document, in the groups of all its texts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import near_copies
from slotwise.llm.frames import discard, fresh, settle
from slotwise.llm.shingles import links_of_blocks as _links_of_blocks
from slotwise.llm.sketches import BLOCK, CROWD, sketch_groups

__all__ = ["SHINGLE", "_links_of_blocks", "one_of_each", "similar_groups"]

SHINGLE = 5
#: Bits in which fingerprints of a pair may differ, and the blocks that the trees work on.
RADIUS, BLOCKS = 7, 4
#: Rounds in which the lists meet pivots: fingerprints have joined most, so later rounds would find next to nothing.
ROUNDS = 1


def by_fingerprints(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of ids of (id, text) rows whose fingerprints lie close."""
    return near_copies.likely_pairs(rows, SHINGLE, RADIUS, BLOCKS)


def similar_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD, block: int = BLOCK
) -> DataFrame:
    """doc_id and component (the least id reachable) of every document with an id."""
    found = sketch_groups(
        docs, doc_id, text, SHINGLE, wordless=True, crowd=crowd, block=block, likely=by_fingerprints, rounds=ROUNDS
    )
    return found.where("doc_id is not null").select("doc_id", "component")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the document of least id of each group; a row without id stays."""
    own = fresh("id")
    with discard(docs.sparkSession) as keep:
        found = similar_groups(docs, doc_id, text)
        copies = found.where("doc_id != component").select(F.col("doc_id").alias(own))
        copies = keep(settle(copies, "copies"))
    # never by broadcast, so that the plan is the same whatever the number of copies
    return docs.join(copies.hint("merge"), docs[doc_id] == copies[own], "left_anti")
