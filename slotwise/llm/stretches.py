"""Windows of documents that occur more than once anywhere, found shard by shard.

The windows of a text are winnowed: each belongs to the stretch that chose the same place, and equal
windows have the same mark and offset, whatever surrounds them. So a window that occurs twice has
both places in stretches of one mark, and each place is in one stretch only. That deals the work
out: stretches whose mark occurs once are dropped, equal stretches of a mark are kept as one class,
and the classes go to shards by mark, where a search reports the windows that occur elsewhere. A
class that stands for several places takes part twice.

A mark with more classes than a shard should hold has its windows compared by their digests in an
ordinary grouping instead, one row for each window; so no mark, however common, comes to one task.
"""

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import spans
from slotwise.llm.frames import partitions_for, settle

#: Text taken from a batch at once, in bytes.
AT_ONCE = 1 << 20
#: Classes of one mark that a shard takes.
MOST_CLASSES = 1024
#: Bytes of classes in a shard, in the mean.
SHARD_BYTES = 1 << 20


@dataclass(frozen=True)
class Units:
    """What a text is made of: bytes, or words between blanks."""

    window: int
    gram: int
    words: bool

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each unit of a batch of texts, and the bounds of the texts."""
        if self.words:
            _, words, hashes = spans.words_of(column, spans.NOT_BLANK)
            return hashes, words.bounds
        raw, offsets = spans.text_bytes(column)
        return spans.BYTE_VALUES[raw], offsets

    def items(self, raw: bytes) -> bytes | list[bytes]:
        """The units of one text, in a row that can be cut."""
        return raw.split() if self.words else raw

    def joined(self, parts: list) -> bytes:
        """Parts of such a row as text again; words are set one space apart."""
        return b" ".join(w for p in parts for w in p) if self.words else b"".join(parts)


#: Given the bodies of a shard's classes, how far each one's last window begins before its mark, which
#: of them stand for several places, and the window: whether each window of each occurs elsewhere.
Search = Callable[[list[bytes], list[int], list[bool], int], list[np.ndarray]]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * AT_ONCE // max(batch.nbytes, AT_ONCE)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def marked(docs: DataFrame, units: Units) -> DataFrame:
    """(id, mark, whole, first, last, gap) for each stretch of (id, text) rows.

    The gap is the way from the last window's begin to the mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, bounds = units.of(part.column(1))
                for s in spans.winnow(values, bounds, units.window, units.gram, wholes=True):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(s.text)),
                            pa.array(s.mark.view(np.int64)),
                            pa.array(s.whole.view(np.int64)),
                            pa.array(s.first.astype(np.int32)),
                            pa.array(s.last.astype(np.int32)),
                            pa.array((s.place - s.last).astype(np.int32)),
                        ],
                        ["id", "mark", "whole", "first", "last", "gap"],
                    )

    schema = "id bigint, mark bigint, whole bigint, first int, last int, gap int"
    return docs.where("id is not null").select("id", "text").mapInArrow(run, schema)


def told_apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` (id, text) with an id of its own for every text, and what gives results the first ids back.

    Where an id has several texts, each of them gets a number below all ids. Tables without such
    ids are left as they are, after one count of ids; only tables with some are dealt out by their texts.
    Rows that repeat an id with one text share it.
    """

    def as_they_are(found: DataFrame) -> DataFrame:
        return found

    ids = docs.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = settle(ids.select("id"), "repeated-ids")
    if ids.isEmpty():
        return docs, as_they_are
    marked_rows = docs.withColumn("kind", F.md5(F.coalesce("text", F.lit(""))))
    kinds = marked_rows.select("id", "kind").join(ids.hint("merge"), "id", "left_semi").distinct()
    kinds = settle(kinds, "texts-of-ids")
    several = kinds.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    kinds = settle(kinds.join(several, "id", "left_semi"), "several-texts")
    if kinds.isEmpty():
        return docs, as_they_are
    lowest = docs.agg(F.min("id")).first()[0]
    number = F.lit(lowest - 1) - F.monotonically_increasing_id()
    kinds = settle(kinds.select("id", "kind", number.alias("number")), "numbered-texts")
    rows = marked_rows.join(kinds.hint("merge"), ["id", "kind"], "left")
    rows = settle(rows.select(F.coalesce("number", "id").alias("id"), "text"), "texts-told-apart")
    given = kinds.select(F.col("number").alias("id"), F.col("id").alias("given"))

    def restored(found: DataFrame) -> DataFrame:
        named = found.join(given.hint("merge"), "id", "left")
        return named.select(F.coalesce("given", "id").alias("id"), *[c for c in found.columns if c != "id"])

    return rows, restored


def packed(docs: DataFrame) -> DataFrame:
    """(id, blob): texts made small before they are sent anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch):
                blobs = [None if t is None else encode(t.encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(blobs, pa.binary())], ["id", "blob"]
                )

    return docs.select("id", "text").mapInArrow(run, "id bigint, blob binary")


def unpack(blob: bytes | None) -> bytes:
    return b"" if blob is None else zstandard.ZstdDecompressor().decompress(blob)


def bodies(docs: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """The text of the wanted stretches (mark, whole, twice, split, id, first, last, gap).

    A row holds the body of a stretch, or, if it is to be split, the digest of one of its windows.
    """
    wants = wanted.groupBy("id").agg(
        F.collect_list(
            F.struct("mark", "whole", "twice", "split", "first", "last", "gap")
        ).alias("wants")
    )
    # never by broadcast, so that the plan is the same whatever the number wanted
    rows = packed(docs).join(wants.hint("merge"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = unpack(batch.column(0)[row].as_py())
                row_items = units.items(raw)
                out = []
                for w in batch.column(1)[row].as_py():
                    first, last = w["first"], w["last"]
                    same = (w["mark"], w["whole"], w["twice"], w["gap"])
                    if not w["split"]:
                        held = units.joined([row_items[first : last + units.window]])
                        out.append((*same, -1, held))
                        continue
                    for at in range(first, last + 1):
                        held = units.joined([row_items[at : at + units.window]])
                        digest = xxhash.xxh3_128_digest(held)
                        out.append((*same, at - first, digest))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["mark", "whole", "twice", "gap", "offset", "body"],
                )

    schema = "mark bigint, whole bigint, twice boolean, gap int, offset int, body binary"
    return rows.select("blob", "wants").mapInArrow(run, schema)


def _ranges(shared: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of true values, as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], shared.astype(np.int8), [0]])))
    yield from zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)


def repeated_spans(docs: DataFrame, units: Units, search: Search) -> DataFrame:
    """(id, spans): for each document with any, the begin and end of runs of repeated windows, in
    units; runs may touch or overlap."""
    spark = docs.sparkSession
    rows = marked(docs, units)
    # the stretches are found twice rather than stored: all but a few are dropped by the join
    marks = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("places")).where("places > 1")
    marks = settle(marks.select("mark"), "marks")
    shared = settle(rows.join(marks.hint("merge"), "mark", "left_semi"), "stretches")
    classes = shared.groupBy("mark", "whole").agg(
        F.count(F.lit(1)).alias("places"), F.min(F.struct("id", "first", "last", "gap")).alias("one")
    )
    classes = settle(classes, "classes")
    crowded = classes.groupBy("mark").agg(F.count(F.lit(1)).alias("classes"))
    crowded = settle(crowded.where(F.col("classes") > MOST_CLASSES), "crowded-marks")
    wanted = classes.join(crowded, "mark", "left").select(
        "mark",
        "whole",
        (F.col("places") > 1).alias("twice"),
        F.col("classes").isNotNull().alias("split"),
        "one.*",
    )
    found = settle(bodies(docs, wanted, units), "bodies")
    total = found.where("offset < 0").agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def in_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mark", "whole"])
        hits = search(
            rows["body"].tolist(), rows["gap"].tolist(), rows["twice"].tolist(), units.window
        )
        out = [
            (mark, whole, first, last)
            for mark, whole, hit in zip(rows["mark"], rows["whole"], hits, strict=True)
            for first, last in _ranges(hit)
        ]
        return pd.DataFrame(out, columns=["mark", "whole", "from", "to"]).astype(
            {"mark": "int64", "whole": "int64", "from": "int32", "to": "int32"}
        )

    schema = "mark bigint, whole bigint, from int, to int"
    within = (
        found.where("offset < 0")
        .withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)))
        .repartition(partitions_for(total, spark, SHARD_BYTES), "shard")
        .groupBy("shard")
        .applyInPandas(in_shard, schema)
    )
    split = found.where("offset >= 0")
    times = F.sum(F.when(F.col("twice"), 2).otherwise(1))
    repeated = split.groupBy("mark", "body").agg(times.alias("n")).where("n > 1")
    by_digest = split.join(repeated, ["mark", "body"]).select(
        "mark", "whole", F.col("offset").alias("from"), F.col("offset").alias("to")
    )
    hits = settle(within.unionByName(by_digest), "repeats")
    placed = shared.join(hits.hint("merge"), ["mark", "whole"]).select(
        "id",
        (F.col("first") + F.col("from")).alias("begin"),
        (F.col("first") + F.col("to") + units.window).alias("end"),
    )
    grouped = placed.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return settle(grouped, "repeated-spans")


def without_spans(docs: DataFrame, found: DataFrame, units: Units, digests: bool) -> DataFrame:
    """(id, n_units, n_removed, n_spans, kept): every document without its repeated spans.

    With ``digests``, kept is the SHA-256 of what remains, otherwise the remaining text.
    """
    # never by broadcast, so that the plan is the same whatever the number found
    rows = packed(docs).join(found.hint("merge"), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                raw = unpack(batch.column(1)[row].as_py())
                held = batch.column(2)[row].as_py() or []
                row_items = units.items(raw)
                total = len(row_items)
                begin = np.array([h["begin"] for h in held], np.int64)
                end = np.array([h["end"] for h in held], np.int64)
                begin, end = spans.covered(begin, end)
                gaps = zip([0, *end.tolist()], [*begin.tolist(), total], strict=True)
                kept = units.joined([row_items[a:b] for a, b in gaps])
                value = hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "replace")
                out.append((total, int((end - begin).sum()), len(begin), value))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["id", "n_units", "n_removed", "n_spans", "kept"],
            )

    schema = "id bigint, n_units bigint, n_removed bigint, n_spans bigint, kept string"
    return rows.select("id", "blob", "spans").mapInArrow(run, schema)
