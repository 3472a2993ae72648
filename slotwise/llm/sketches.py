"""Near copies by bottom-k sketches: texts whose sets of word shingles are alike to 0.8 or more.

One hash function orders all shingles; a sketch is the ``SKETCH`` least hashes of a set. Of the least
``SKETCH`` hashes of the union of two sets each lies in both with a chance of their similarity, and
one that lies in both is in both sketches. Two sketches of texts alike to 0.8 therefore share
``SHARED`` values or more, but for one pair in 10**11; sets of up to ``EXACT`` shingles are always told
rightly, since their sketch is the whole set or nearly so.

The steps: equal sets are one node. Inverted lists of sketch values bring nodes together. A
value that many hold comes last in a sketch's own order, and the last ``SHARED - 1`` values of each
sketch need no list, as two sketches that share ``SHARED`` values also share one of the others.
In each list all meet one pivot (a new one each round); the sketch of the union, made of both sketches,
drops pairs that are not alike, and the rest are compared by their whole sets. What a few rounds
leave in different components is compared pair by pair, or, where a list is long, in
blocks of its smaller components against all of it.

Defined results: words are lower-cased (ASCII) and lie between blanks; a text of fewer words than
a shingle is one shingle; null and wordless texts have no shingle and are linked with nothing (or,
if asked, with each other). A row without an id has no component. Rows that repeat an id are one
node, so the groups of all its texts are one. Equal rows change nothing.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm import spans
from slotwise.llm.components import components
from slotwise.llm.frames import discard, keyed_text, settle
from slotwise.llm.shingles import links_of_blocks, lists, pieces, shingle_sets

#: Values of a sketch; what two similar sketches share at least; sets whose sketch decides alone.
SKETCH, SHARED, EXACT = 64, 26, 51
#: Rounds in which every list meets one pivot.
ROUNDS = 3
#: Members of a list that are still paired as rows; members of a block beyond that.
CROWD, BLOCK = 64, 512
#: Members that one copy of a star's centre serves.
ARM = 256


def sketch_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n, high, low, sketch): size of each set, 128 bits that tell it, its least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            text, found = shingle_sets(part.column(1), shingle)
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
            n = np.diff(bounds)
            held = np.flatnonzero(n)
            sums = [np.zeros(part.num_rows, np.uint64) for _ in range(2)]
            if len(held):
                for total, salt in zip(sums, (1, 2), strict=True):
                    salted = spans.mix(found + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64))
                    total[held] = np.add.reduceat(salted, bounds[held])
            # hashes of a text are in order
            least = found[np.arange(len(found)) - bounds[:-1][text] < SKETCH]
            ends = np.concatenate([[0], np.cumsum(np.minimum(n, SKETCH))])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(n.astype(np.int64)),
                    *[pa.array(total.view(np.int64)) for total in sums],
                    lists(least, ends),
                ],
                ["id", "n", "high", "low", "sketch"],
            )

    schema = "id bigint, n bigint, high bigint, low bigint, sketch array<bigint>"
    return docs.select("id", "text").mapInArrow(run, schema)


def _sizes_fit(a: str, b: str) -> Column:
    return (5 * F.col(a) >= 4 * F.col(b)) & (5 * F.col(b) >= 4 * F.col(a))


def leading_members(own: DataFrame) -> DataFrame:
    """(value, node, n): the values under which each sketch is listed.

    Of a sketch's values, the rarest first, all but the last ``SHARED - 1`` (a fifth of a small set
    and one more). Values that one sketch alone holds lead, and need no list.
    """
    values = own.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    times = values.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    times = settle(times, "values-shared")
    held = values.join(times.hint("merge"), "value")
    shared = F.when(F.col("n") <= EXACT, F.ceil(F.col("size") * 4 / 5)).otherwise(SHARED)
    mine = Window.partitionBy("node", "n", "size")
    place = F.row_number().over(mine.orderBy("times", "value"))
    alone = F.col("size") - F.count(F.lit(1)).over(mine)
    led = held.select("value", "node", "n", (place + alone).alias("place"), (F.col("size") - shared).alias("last"))
    return led.where("place <= last + 1").select("value", "node", "n")


def alike_sketches(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose union's sketch holds enough values of both."""
    one = own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("_a"))
    two = own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("_b"))
    met = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(_sizes_fit("na", "nb"))
    union = F.slice(F.array_sort(F.array_union("_a", "_b")), 1, SKETCH)
    both = F.size(F.array_intersect(union, F.array_intersect("_a", "_b")))
    least = F.when(F.greatest("na", "nb") <= EXACT, F.ceil(4 * F.greatest("na", "nb") / 5)).otherwise(SHARED)
    return met.where(both >= least).select("a", "b").distinct()


def alike_texts(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike to 0.8.

    Texts are sent once for each pair; the text of ``a`` goes ahead of every ``ARM`` of its partners, so a
    task holds one set and the batch that meets it, however many partners there are.
    """
    pairs = settle(pairs, "pairs-to-verify")
    arms = settle(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / ARM).alias("arms")), "arms")
    dealt = F.pmod(F.xxhash64("b"), F.col("arms")).alias("arm")
    pairs = pairs.join(arms.hint("merge"), "a").select("a", "b", dealt)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("arms") - 1)).alias("arm")
    heads = arms.select("a", every, F.lit(0).alias("turn"), F.col("a").alias("id"))
    arms = pairs.select("a", "arm", F.lit(1).alias("turn"), F.col("b").alias("id"))
    wanted = heads.unionByName(arms)
    met = (
        docs.join(wanted.hint("merge"), "id")
        .repartition("a", "arm")
        .sortWithinPartitions("a", "arm", "turn")
        .select("a", "arm", "turn", "id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centres = None, []
        for part in pieces(batches):
            text, found = shingle_sets(part.column(4), shingle)
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
            heads = zip(*[part.column(k).to_pylist() for k in range(4)], strict=True)
            out: list[tuple[int, int]] = []
            for row, (a, arm, turn, other) in enumerate(heads):
                own = found[bounds[row] : bounds[row + 1]]
                if (a, arm) != star:
                    star, centres = (a, arm), []
                if turn == 0:
                    # rows that repeat an id and its text count once
                    if not any(np.array_equal(own, c) for c in centres):
                        centres.append(own)
                    continue
                for centre in centres:
                    shared = len(np.intersect1d(centre, own, assume_unique=True))
                    if 9 * shared >= 4 * (len(centre) + len(own)):
                        out.append((a, other))
                        break
            ids = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def _rooted(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
    roots = components(links)
    return settle(
        members.select("value", "node", "n")
        .join(roots.withColumnRenamed("node", "_node").hint("merge"), F.col("node") == F.col("_node"), "left")
        .select("value", "node", "n", F.coalesce("root", "node").alias("root")),
        name,
    )


def _unsettled(members: DataFrame, name: str) -> DataFrame:
    """Members of lists that still hold nodes of different components."""
    apart = members.groupBy("value").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).where("_x != _y")
    return settle(members.join(apart.select("value").hint("merge"), "value", "left_semi"), name)


def _star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node with the least pivot of its lists that is in another component."""
    rank = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
    ranked = members.withColumn("_rank", rank)
    least = settle(ranked.groupBy("value").agg(F.min("_rank").alias("_rank")), "pivot-ranks")
    pivots = ranked.join(least.hint("merge"), ["value", "_rank"]).select(
        "value", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra")
    )
    met = members.join(settle(pivots.distinct(), "pivots").hint("merge"), "value")
    met = met.where((F.col("node") != F.col("a")) & (F.col("root") != F.col("ra")) & _sizes_fit("n", "na"))
    # one pair a node and round: what stays apart meets the other pivots later
    return met.groupBy("node").agg(F.min("a").alias("a")).select("a", F.col("node").alias("b"))


def _few_pairs(members: DataFrame) -> DataFrame:
    one = members.select("value", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    two = members.select("value", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    met = one.join(two.hint("merge"), "value").where(
        (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _sizes_fit("na", "nb")
    )
    return met.select("a", "b").distinct()


def _crowd_links(members: DataFrame, docs: DataFrame, shingle: int, block: int) -> DataFrame:
    """Links within long lists: blocks of all but the largest component, against blocks of all.

    Lists of one largest component hold much the same nodes, so they are taken together, and a
    node is sent once for all of them.
    """
    kinds = settle(members.groupBy("value", "root").agg(F.count(F.lit(1)).alias("times")), "crowd-roots")
    most = kinds.groupBy("value").agg(F.max("times").alias("most"))
    big = kinds.join(most.hint("merge"), "value").where("times = most").groupBy("value").agg(
        F.min("root").alias("big")
    )
    named = members.join(settle(big, "crowd-largest").hint("merge"), "value")
    members = named.groupBy("big", "node").agg(F.min("root").alias("root"))
    members = settle(members.withColumnRenamed("big", "value"), "crowd-members")
    parts = members.groupBy("value").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("columns"),
        F.ceil(F.count_if(F.col("root") != F.col("value")) / block).cast("int").alias("rows"),
    )
    parts = settle(parts, "crowd-parts")
    dealt = members.join(parts.hint("merge"), "value")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    down = dealt.select("value", "node", own("columns").alias("y"), every("rows").alias("x"))
    across = dealt.where("root != value").select("value", "node", own("rows").alias("x"), every("columns").alias("y"))
    met = down.unionByName(across).distinct().select("value", "x", "y", F.col("node").alias("id"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            text, found = shingle_sets(part.column(1), shingle)
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), lists(found, bounds)], ["id", "shingles"])

    some = settle(met.select("id").distinct(), "crowd-ids")
    texts = docs.join(some.hint("merge"), "id", "left_semi").select("id", "text")
    sets = settle(texts.mapInArrow(shingled, "id bigint, shingles array<bigint>"), "crowd-sets")

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_of_blocks(rows), columns=["a", "b"])

    return (
        met.join(sets.hint("merge"), "id")
        .groupBy("value", "x", "y")
        .applyInPandas(joined, "a bigint, b bigint")
        .where("a != b")
        .distinct()
    )


def _confirmed(pairs: DataFrame, own: DataFrame, docs: DataFrame, shingle: int, name: str) -> DataFrame:
    """The pairs (a, b) that sketches, then whole sets, find alike; what leads there is deleted."""
    with discard(docs.sparkSession) as keep:
        alike = settle(alike_sketches(pairs, own), "pairs-alike")
        return keep(settle(alike_texts(alike, docs, shingle), name))


def links(
    own: DataFrame,
    docs: DataFrame,
    shingle: int,
    crowd: int = CROWD,
    block: int = BLOCK,
    likely: DataFrame | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(a, b): links that join all similar nodes; ``own`` has node, n and sketch.

    ``likely`` pairs of nodes are compared first, and the lists go on from the components that they give.
    ``rounds`` of pivots spare pairs and blocks; what they leave apart is compared in any case, so their number
    changes no result.
    """
    members = settle(leading_members(own), "lists").withColumn("root", F.col("node"))
    found = None
    if likely is not None:
        found = _confirmed(likely, own, docs, shingle, "links-likely")
        members = _rooted(members, found, "lists-likely")
    for turn in range(rounds):
        members = _unsettled(members, f"lists-{turn}")
        if members.isEmpty():
            return found if found is not None else members.select(F.col("node").alias("a"), F.col("node").alias("b"))
        new = _confirmed(_star_pairs(members, turn), own, docs, shingle, "star-links")
        found = new if found is None else settle(found.unionByName(new), "links")
        members = _rooted(members, found, "lists-rooted")
    members = _unsettled(members, "lists-left")
    sizes = members.groupBy("value").agg(F.count(F.lit(1)).alias("times"))
    sizes = settle(sizes, "list-sizes")
    few = members.join(sizes.where(F.col("times") <= crowd).hint("merge"), "value", "left_semi")
    rest = _confirmed(_few_pairs(settle(few, "lists-short")), own, docs, shingle, "links-left")
    many = members.join(sizes.where(F.col("times") > crowd).hint("merge"), "value", "left_semi")
    many = settle(many, "lists-long")
    found = rest if found is None else found.unionByName(rest)
    if many.isEmpty():
        return found
    return found.unionByName(settle(_crowd_links(many, docs, shingle, block), "links-crowd"))


def sketch_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    wordless: bool = False,
    crowd: int = CROWD,
    block: int = BLOCK,
    likely: Callable[[DataFrame], DataFrame] | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, n_shingles and component (the least id reachable) of every row.

    ``wordless`` makes texts without words one group; otherwise each is alone. ``likely`` gives, for rows
    (id, text), pairs of ids (a, b) from another method; they are compared before the lists are. ``rounds``: see
    :func:`links`.
    """
    given = keyed_text(docs, doc_id, text)
    with discard(docs.sparkSession) as keep:
        rows = keep(settle(sketch_rows(given, shingle), "sketches"))
        linked = rows.where("id is not null" if wordless else "id is not null and n > 0")
        same = settle(linked.groupBy("n", "high", "low").agg(F.min("id").alias("least")), "distinct-sets")
        first = same.where("n > 0").withColumnRenamed("least", "id")
        first = linked.join(first.hint("merge"), ["n", "high", "low", "id"]).dropDuplicates(["n", "high", "low", "id"])
        own = settle(first.select(F.col("id").alias("node"), "n", "sketch"), "distinct-sketches")
        # an id with several texts joins what each of them is in
        several = linked.groupBy("id").agg(F.min("high").alias("_x"), F.max("high").alias("_y")).where("_x != _y")
        one_id = (
            linked.select("id", "n", "high", "low")
            .join(several.select("id").hint("merge"), "id", "left_semi")
            .join(same.hint("merge"), ["n", "high", "low"])
            .select(F.col("least").alias("a"), F.col("id").alias("b"))
        )
        texts = given.where("id is not null")
        first_pairs = None
        if likely is not None:
            held = linked.join(same.hint("merge"), ["n", "high", "low"]).select("id", "least")
            held = settle(held.distinct(), "nodes-of-ids")
            met = settle(likely(texts), "pairs-given")
            for side in ("a", "b"):
                node = held.select(F.col("id").alias(side), F.col("least").alias(f"_{side}"))
                met = met.join(node.hint("merge"), side)
            first_pairs = met.where("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
        found = links(own, texts, shingle, crowd, block, first_pairs, rounds).unionByName(settle(one_id, "one-id"))
        roots = components(found)
        sets = same.join(roots.hint("merge"), same["least"] == roots["node"], "left").select(
            "n", "high", "low", F.coalesce("root", "least").alias("component")
        )
        sets = keep(settle(sets, "components"))
    plain = rows.select("id", "n", "high", "low")
    return plain.join(sets.hint("merge"), ["n", "high", "low"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"),
    )
