"""A Merkle manifest of a table: a leaf for each row, a tree for each source, one over the sources.

A node is the SHA-256 of its (at most ``FANOUT``) children's digests. Leaves are numbered in their
source without a global sort. The digits of that number, base ``FANOUT``, are columns: grouping by all
but the lowest digit, then by all but the two lowest, and so on nests child structs into their parents. That goes
on for ``LEVELS`` digits, so a nested row holds a block of at most ``FANOUT ** LEVELS`` leaves; the
blocks' own digests are the leaves of the next pass, and blocks of one source may lie anywhere. On the way
back each block, which still holds everything below it, gets what stands above it (one row for
each block), and one transform and an explode emit the proofs of all its leaves.

Defined results: every row is a leaf, rows that repeat an id too (ordered by their leaf, then by what
it became); a null id comes first and is never tampered with; a null source is a source of its
own, before all others; a null value is ``-``; an empty table has no leaves, no root and gives no
rows. Further columns of a table, whatever their names, are not read.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.frames import discard, settle, table
from slotwise.operators.ranks import row_places

FANOUT, LEVELS = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGITS = [f"d{k}" for k in range(LEVELS)]
_BLOCK = FANOUT**LEVELS


def encoded(value: Column) -> Column:
    """``-`` for null, otherwise the length in bytes, a colon and the value: no two values alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*values), 256)


def without_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def tampered_rows(key: Column) -> Column:
    """Rows whose key has an even CRC-32; a null key has none."""
    return F.coalesce(F.crc32(key.cast("string")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(id, source, leaf, other): each row's leaf, and what it is once tampered with."""
    key, source, text = fields[0], fields[1], fields[-1]
    own = table(docs, **{f"f{k}": name for k, name in enumerate(fields)})
    values = [F.col(f"f{k}") for k in range(len(fields))]
    plain = [encoded(v) for v in values]
    spoiled = [*plain[:-1], encoded(without_newlines(values[-1]))]
    leaf = digest(plain)
    return own.select(
        F.col("f0").alias("id"),
        F.col("f1").alias("source"),
        leaf.alias("leaf"),
        F.when(tampered_rows(values[0]), digest(spoiled)).otherwise(leaf).alias("other"),
    )


def _live(size: Column, level: int) -> Column:
    """Whether ``size`` nodes are still several once ``level`` levels have been grouped away."""
    return size > FANOUT**level


def _nest(nodes: DataFrame) -> DataFrame:
    """(tree, block, size, hash, kids) of nodes (tree, nr, size, hash, kids): a row for each block."""
    digits = [(F.floor(F.col("nr") / FANOUT**k) % FANOUT).cast("int").alias(d) for k, d in enumerate(_DIGITS)]
    rows = nodes.select(
        "tree", F.floor(F.col("nr") / _BLOCK).alias("block"), "size", *digits, "hash", "kids"
    ).repartition("tree", "block")
    # the rows of a block stay where they are: all keys begin with the block
    for level, digit in enumerate(_DIGITS):
        kids = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), "hash", "kids")))
        rows = rows.groupBy("tree", "block", "size", *_DIGITS[level + 1 :]).agg(kids.alias("kids"))
        together = F.sha2(F.array_join(F.transform("kids", lambda c: c["hash"]), ""), 256)
        own = F.when(_live(F.col("size"), level), together).otherwise(F.col("kids")[0]["hash"])
        rows = rows.withColumn("hash", own)
    return rows.select("tree", "block", "size", "hash", "kids")


def _siblings(kids: Column, child: Column) -> Column:
    def joined(which) -> Column:
        return F.array_join(F.transform(F.filter(kids, which), lambda c: c["hash"]), "")

    return F.struct(
        joined(lambda c: c["digit"] < child["digit"]).alias("before"),
        joined(lambda c: c["digit"] > child["digit"]).alias("after"),
    )


def _paths(kids: Column, level: int = LEVELS - 1) -> Column:
    """(leaf, path) of every leaf below ``kids``; a path has a step for each level of the block."""

    def step(child: Column) -> Column:
        own = F.array(_siblings(kids, child))
        return F.when(_live(F.col("size"), level), own).otherwise(F.filter(own, lambda _: F.lit(False)))

    if level == 0:
        return F.transform(kids, lambda c: F.struct(c["kids"].alias("leaf"), step(c).alias("path")))
    return F.flatten(
        F.transform(
            kids,
            lambda c: F.transform(
                _paths(c["kids"], level - 1),
                lambda x: F.struct(x["leaf"].alias("leaf"), F.concat(x["path"], step(c)).alias("path")),
            ),
        )
    )


def grown(nodes: DataFrame, name: str) -> tuple[list[DataFrame], int]:
    """Blocks of nodes (tree, nr, size, hash, kids), pass by pass until a tree is one block.

    The number of passes follows from the largest tree, the only figure read.
    """
    passes: list[DataFrame] = []
    most = nodes.agg(F.max("size")).head()[0] or 1
    while True:
        passes.append(settle(_nest(nodes), f"{name}-blocks"))
        if most <= _BLOCK:
            return passes, most
        most = -(-most // _BLOCK)
        nodes = passes[-1].select(
            "tree", F.col("block").alias("nr"), F.ceil(F.col("size") / _BLOCK).alias("size"), "hash",
            F.col("block").alias("kids"),
        )


def descended(passes: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """(leaf, path, ...) of every leaf; ``above`` has tree, path and what else its leaves are given."""
    given = [c for c in above.columns if c not in ("tree", "path")]
    above = above.withColumn("block", F.lit(0).cast("bigint"))
    for k, blocks in reversed([*enumerate(passes)]):
        met = blocks.join(above.select("tree", "block", F.col("path").alias("_above"), *given), ["tree", "block"])
        found = met.select("tree", "_above", *given, F.explode(_paths(F.col("kids"))).alias("_x"))
        path = F.concat("_x.path", "_above").alias("path")
        if k == 0:
            return found.select(F.col("_x.leaf").alias("leaf"), path, *given)
        # the leaves of this pass are the blocks of the one below
        above = settle(found.select("tree", F.col("_x.leaf").alias("block"), path, *given), f"{name}-paths")
    raise ValueError("no passes")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """id, source, leaf, subroot, root, path (its steps' siblings), and the tampered leaf, ``other``.

    ``fields`` names the columns that are hashed: the id first, then the source, the text last.
    """
    with discard(docs.sparkSession) as keep:
        own = settle(leaves(docs, fields), "leaves")
        order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf", "other"]
        own = own.withColumn("tree", encoded(F.col("source")))
        nodes = row_places(own, ["tree"], order, "leaves-placed").select(
            "tree", F.col("_nr").alias("nr"), F.col("_rows").alias("size"), F.col("leaf").alias("hash"),
            F.struct("id", "source", "leaf", "other").alias("kids"),
        )
        below, _ = grown(settle(nodes, "leaves-numbered"), "source")
        tops = below[-1].select(F.col("tree").alias("name"), F.col("hash").alias("subroot"))
        # what a source is called does not order like it: the name starts with a length
        named = own.select("tree", "source").distinct().withColumnRenamed("tree", "name")
        tops = settle(tops.join(named, "name").withColumn("tree", F.lit("")), "subroots")
        order = [F.col("source").asc_nulls_first()]
        nodes = row_places(tops, ["tree"], order, "subroots-placed").select(
            "tree", F.col("_nr").alias("nr"), F.col("_rows").alias("size"), F.col("subroot").alias("hash"),
            F.struct("name", "subroot").alias("kids"),
        )
        upper, _ = grown(settle(nodes, "subroots-numbered"), "root")
        no_path = F.expr("cast(array() as array<struct<before: string, after: string>>)")
        root = upper[-1].select("tree", no_path.alias("path"), F.col("hash").alias("root"))
        sources = descended(upper, root, "root").select(
            F.col("leaf.name").alias("tree"), "path", F.col("leaf.subroot").alias("subroot"), "root"
        )
        found = descended(below, settle(sources, "source-paths"), "source")
        return keep(settle(found.select("leaf.*", "path", "subroot", "root"), "manifest"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf up and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")
