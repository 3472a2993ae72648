"""Near copies by SimHash fingerprints, paired exactly through vantage-point trees.

Two fingerprints of 64 bits that differ in at most three have a half of 32 bits in which they
differ in at most one. The distance in a half obeys the triangle inequality, so for each half a tree
of vantage points deals the fingerprints out: those within a threshold of the vantage point go to
the left, the others to the right, and those that lie within the radius of the boundary to both. Any
pair within the radius of one another then meets in some shard. The top of each tree is laid out
from a bounded sample, and every fingerprint finds its shards by it. Within a shard the tree goes on
in memory to small leaves, where fingerprints are compared in full. A shard or leaf gives a forest
of links, never all its pairs, and the links of all shards are joined to components. A wider radius takes
more blocks than two halves, each with its share of the radius.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; a text
of fewer words than a shingle is one shingle; equal fingerprints are one component; a row without
an id takes part in no minimum. Further columns are ignored, or kept by :func:`one_of_each`.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import spans
from slotwise.llm.components import components
from slotwise.llm.frames import fresh, keyed_text, settle

SEED = 42
RADIUS = 3
#: Equal parts of a fingerprint; two within RADIUS differ in some part by at most RADIUS // HALVES.
HALVES = 2
#: Distinct fingerprints that one shard should hold, and that the top of a tree is laid out from.
SHARD, SAMPLE = 8192, 16384
LEAF = 128
#: Words whose shingles are counted at once.
AT_ONCE = 1 << 16


def fingerprints_of(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """The fingerprint of every text of a batch."""
    raw, offsets = spans.text_bytes(column)
    raw = spans.LOWER[raw]
    words = spans.find_words(raw, offsets, spans.NOT_BLANK)
    counts = np.diff(words.bounds)
    lengths = words.ends - words.starts
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    total = int(begins[-1] + lengths[-1] + 1) if len(begins) else 0
    # the words of the batch again, each followed by one space
    take = np.repeat(words.starts - begins, lengths + 1) + np.arange(total)
    spaced = raw[np.minimum(take, max(0, len(raw) - 1))] if total else raw[:0]
    spaced[begins + lengths] = 0x20
    held = spaced.tobytes()
    ends = begins + lengths
    found = np.zeros(len(counts), np.uint64)
    # shingles of each text: at least one if it has a word
    number = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(number)])
    digest = xxhash.xxh64_intdigest
    for lo, hi in spans.groups(bounds, AT_ONCE):
        n = number[lo:hi]
        inner = np.arange(bounds[hi] - bounds[lo]) - np.repeat(bounds[lo:hi] - bounds[lo], n)
        first = np.repeat(words.bounds[lo:hi], n) + inner
        last = first + np.repeat(np.minimum(counts[lo:hi], shingle), n) - 1
        pairs = zip(begins[first].tolist(), ends[last].tolist(), strict=True)
        hashes = np.fromiter((digest(held[a:b], SEED) for a, b in pairs), np.uint64, len(first))
        held_texts = np.flatnonzero(n)
        if len(held_texts):
            found[lo + held_texts] = _majority(hashes, n[held_texts])
    return found


def _majority(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Each text's fingerprint from the hashes of its shingles, which stand one after another."""
    starts = np.cumsum(number) - number
    sums = np.zeros((len(number), 64), np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at : at + AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a = int(np.searchsorted(starts, at, "right")) - 1
        b = int(np.searchsorted(starts, at + len(part), "left"))
        edges = np.maximum(starts[a:b] - at, 0)
        sums[a:b] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    set_bits = 2 * sums > number[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_rows(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(id, fp) for (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * (8 << 20) // max(batch.nbytes, 8 << 20)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                fps = fingerprints_of(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fps.view(np.int64))], ["id", "fp"]
                )

    return docs.select("id", "text").mapInArrow(run, "id bigint, fp bigint")


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Vantage:
    """A node: left holds what is within ``reach`` of ``point``, right what lies beyond
    ``reach - radius``, so that the boundary belongs to both."""

    __slots__ = ("left", "point", "reach", "right")

    def __init__(self, point, reach, left, right):
        self.point, self.reach, self.left, self.right = point, reach, left, right


def best_split(points: np.ndarray, radius: int, tries: int = 6):
    """(vantage point, reach) that leaves least in the larger part, or None if nothing helps."""
    best, least = None, 0.9 * len(points)
    for i in range(tries):
        point = points[(i * 7919 + len(points) // 2) % len(points)]
        near = np.cumsum(np.bincount(distance(points, point), minlength=66))
        for reach in range(int(near.searchsorted(len(points) // 2)) + radius + 1):
            inside = near[reach]
            beyond = len(points) - (near[reach - radius] if reach >= radius else 0)
            if max(inside, beyond) < least:
                best, least = (point, reach), max(inside, beyond)
    return best


def lay_out(sample: np.ndarray, scale: float, radius: int, shard: int) -> Vantage | int:
    """The top of a tree, from a sample that stands for ``scale`` times as many; leaves are 0."""
    if len(sample) * scale <= shard or len(sample) < 8:
        return 0
    split = best_split(sample, radius)
    if split is None:
        return 0
    d = distance(sample, split[0])
    return Vantage(
        *split,
        lay_out(sample[d <= split[1]], scale, radius, shard),
        lay_out(sample[d > split[1] - radius], scale, radius, shard),
    )


def deal(points: np.ndarray, tree, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places of the points in it), leaves numbered by their path from the top."""
    todo = [(tree, 1, np.arange(len(points)))]
    while todo:
        node, path, at = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield path, at
            continue
        d = distance(points[at], node.point)
        todo.append((node.left, 2 * path, at[d <= node.reach]))
        todo.append((node.right, 2 * path + 1, at[d > node.reach - radius]))


def half_of(fps: np.ndarray, half: int, blocks: int = HALVES) -> np.ndarray:
    """The bits of a half of each fingerprint, or of one of more equal blocks."""
    width = 64 // blocks
    return (fps >> np.uint64(width * half) & np.uint64(2**width - 1)).astype(np.uint32)


def links(fps: np.ndarray, keys: np.ndarray, key_radius: int, radius: int) -> list[np.ndarray]:
    """A forest of links (a, b) that joins what is within ``radius``, given that such pairs are
    within ``key_radius`` under ``keys``."""
    found, todo = [], [(fps, keys, key_radius)]
    while todo:
        own, key, reach = todo.pop()
        if len(own) < 2:
            continue
        if len(own) <= LEAF:
            found += _compare(own, radius)
            continue
        split = best_split(key, reach)
        if split is None and key is not own:
            todo.append((own, own, radius))  # equal in the half: go on with the whole
            continue
        if split is None:
            found += _spread(own, radius)
            continue
        d = distance(key, split[0])
        for part in (d <= split[1], d > split[1] - reach):
            kept = own[part]
            todo.append((kept, kept if key is own else key[part], reach))
    return found


def _compare(own: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links of a leaf: everything compared, then each component hung on its first member."""
    near = distance(own[:, None], own[None, :]) <= radius
    if near.sum() == len(own):
        return []
    label = np.arange(len(own))
    while True:
        new = np.where(near, label[None, :], len(own)).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(own)))
    return [np.stack([own[label[moved]], own[moved]], axis=1)]


def _spread(own: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links of fingerprints that lie too close for any split: each component from one member."""
    found, rest = [], own
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            point = front.pop()
            near = distance(rest, point) <= radius
            if near.any():
                reached, rest = rest[near], rest[~near]
                found.append(np.stack([np.full(len(reached), point), reached], axis=1))
                front.extend(reached)
    return found


def near_links(
    fps: DataFrame, shard: int = SHARD, sample: int = SAMPLE, radius: int = RADIUS, blocks: int = HALVES
) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that join all within ``radius``.

    ``blocks`` divides 64; the trees work on blocks, each with its share of the radius.
    """
    reach = radius // blocks
    total = fps.count()
    share = min(1.0, sample / max(total, 1))
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    # about ``sample`` rows, whatever the number of fingerprints
    points = np.sort(np.array([r.fp for r in drawn.collect()], np.int64)).view(np.uint64)
    scale = total / max(len(points), 1)
    trees = [lay_out(half_of(points, n, blocks), scale, reach, shard) for n in range(blocks)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for block, tree in enumerate(trees):
                for leaf, at in deal(half_of(own, block, blocks), tree, reach):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), blocks * leaf + block, np.int64)),
                            pa.array(own[at].view(np.int64)),
                        ],
                        ["shard", "fp"],
                    )

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["fp"].to_numpy().view(np.uint64)
        found = links(own, half_of(own, int(key[0]) % blocks, blocks), reach, radius)
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
        return pd.DataFrame(np.unique(pairs, axis=0).view(np.int64), columns=["a", "b"])

    rows = fps.select("fp").mapInArrow(dealt, "shard bigint, fp bigint")
    return rows.groupBy("shard").applyInPandas(joined, "a bigint, b bigint")


def likely_pairs(nodes: DataFrame, shingle: int, radius: int, blocks: int) -> DataFrame:
    """(a, b): pairs of nodes (id, text) to be compared by what their fingerprints say.

    Nodes of one fingerprint are paired with the least of them, and that one with those that the trees
    link it to.
    """
    rows = settle(fingerprint_rows(nodes, shingle), "fingerprints")
    fps = settle(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    met = settle(near_links(fps, radius=radius, blocks=blocks).distinct(), "fingerprint-links")
    one = fps.select(F.col("fp").alias("a"), F.col("least").alias("_a"))
    two = fps.select(F.col("fp").alias("b"), F.col("least").alias("_b"))
    near = met.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("_a", "_b")
    same = rows.join(fps.hint("merge"), "fp").select(F.col("least").alias("_a"), F.col("id").alias("_b"))
    pairs = near.unionByName(same).where("_a != _b")
    return pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()


def near_copies(
    docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, fp and component (the least id reachable) of every document."""
    rows = settle(fingerprint_rows(keyed_text(docs, doc_id, text), shingle), "fingerprints")
    fps = settle(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(fps)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = settle(rooted.join(least, "root").select("fp", "component"), "components")
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), "fp", "component")


def one_of_each(
    docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with the document of least id of each component; a row without id stays."""
    own = fresh("id")
    found = near_copies(docs, shingle, doc_id, text)
    copies = found.where("doc_id != component").select(F.col("doc_id").alias(own))
    copies = settle(copies, "copies")
    # never by broadcast, so that the plan is the same whatever the number of copies
    return docs.join(copies.hint("merge"), docs[doc_id] == copies[own], "left_anti")
