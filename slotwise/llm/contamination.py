"""Benchmark passages found in documents by winnowed fingerprints.

Words are runs of ASCII digits, letters and everything beyond ASCII, after A-Z is put in small
letters. Every window of ``window`` words keeps the least hash of its ``gram``-word runs. Equal
windows keep the same hash at the same place, so a document and an item that share any span of
``window`` words share a fingerprint: that is the guarantee. A fingerprint's stretch of windows is
then extended word by word: the hits are the windows of the stretch that the item has too, and
neighbouring hits join to spans of any length.

Defined results: a null or wordless text has no words and is never hit; an item of fewer words
than a window, but at least one, is one window of its own length; a null or wordless item is never
found; repeated items are found each under its own id; rows that repeat a document id are one
document each only if their ids differ, so ids must be unique; further columns are ignored.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import spans
from slotwise.llm.frames import keyed_text, settle, table

#: Up to this many item fingerprints (8 bytes each) are sent to the tasks, which then drop other
#: fingerprints at once. Beyond it the same rows meet the items' fingerprints in a join.
SENT_FINGERPRINTS = 2_000_000
#: Mark of the row each document has besides its fingerprints.
NO_MARK = -1

FINGERPRINTS = (
    "id bigint, n_words bigint, size int, mark bigint, first bigint, windows array<bigint>"
)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def fingerprints(
    sizes: list[int], gram: int, known: np.ndarray | None = None, whole: int = 0
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For (id, text) batches: each text's fingerprints for windows of each of ``sizes`` words.

    A row with NO_MARK carries the text's word count. Of others, only those in ``known`` stay, if
    given. With ``whole``, texts of fewer words than ``whole`` are one window of their own length.
    """

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, words, hashes = spans.words_of(batch.column(1), spans.LETTERS_DIGITS, lower=True)
        counts = np.diff(words.bounds)
        texts = [np.arange(batch.num_rows)]
        found = [(np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, NO_MARK), None)]
        for size in sizes:
            bounds = words.bounds
            values = hashes
            if whole and size < whole:
                keep = np.repeat(counts == size, counts)
                values = hashes[keep]
                bounds = np.concatenate([[0], np.cumsum(np.where(counts == size, counts, 0))])
            k = min(gram, size)
            seen = spans.rolling(values, size)
            for s in spans.winnow(values, bounds, size, k):
                mark = _signed(s.mark)
                mark = np.where(mark == NO_MARK, NO_MARK - 1, mark)
                if known is not None:
                    at = np.minimum(np.searchsorted(known, mark), max(0, len(known) - 1))
                    good = known[at] == mark if len(known) else np.zeros(len(mark), bool)
                    s = spans.Selected(*[x[good] for x in vars(s).values()])
                    mark = mark[good]
                texts.append(s.text)
                base = bounds[s.text]
                found.append((s.first, mark, (size, s.last - s.first + 1, seen, base + s.first)))
        text = np.concatenate(texts)
        offsets, pieces, widths = [np.zeros(1, np.int64)], [], []
        total = 0
        for first, _, more in found:
            if more is None:
                offsets.append(np.zeros(len(first), np.int64))
                widths.append(np.zeros(len(first), np.int32))
                continue
            size, lengths, seen, begin = more
            ends = np.cumsum(lengths)
            inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
            pieces.append(seen[np.repeat(begin, lengths) + inner])
            offsets.append(total + ends)
            widths.append(np.full(len(first), size, np.int32))
            total += len(pieces[-1])
        windows = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(_signed(windows))
        )
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(text)),
                pa.array(counts[text]),
                pa.array(np.concatenate(widths)),
                pa.array(np.concatenate([f[1] for f in found])),
                pa.array(np.concatenate([f[0] for f in found])),
                lists,
            ],
            ["id", "n_words", "size", "mark", "first", "windows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few texts at a time: the windows of a batch are many times its text
            step = max(1, int(batch.num_rows * (8 << 20) // max(batch.nbytes, 8 << 20)))
            for at in range(0, batch.num_rows, step):
                yield of_batch(batch.slice(at, step))

    return run


def item_windows(items: DataFrame, window: int = 13, gram: int = 6) -> DataFrame:
    """(mark, size, window, id): every window of every item under its fingerprint."""
    sizes = list(range(1, window + 1))
    rows = items.select("id", "text").mapInArrow(
        fingerprints(sizes, gram, whole=window), FINGERPRINTS
    )
    return rows.where(F.col("mark") != NO_MARK).select(
        "mark", "size", F.explode("windows").alias("window"), "id"
    )


def shared_windows(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    gram: int = 6,
    sent: int = SENT_FINGERPRINTS,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with n_words, hits, classes of items).

    A hit is (doc_id, first word, end, class): a window of the document whose words some items
    have. Items with the very same window share its class, so a passage that many items and many
    documents hold is one row for each document, not one for each pair of occurrences.
    """
    own = settle(
        item_windows(table(items, id=item_id, text=item_text), window, gram), "item-windows"
    )
    per_window = own.groupBy("mark", "size", "window").agg(
        F.sort_array(F.collect_set("id")).alias("ids")
    )
    per_window = settle(
        per_window.select(
            "mark", "size", "window", "ids", F.xxhash64("ids").alias("class_low"),
            F.hash("ids").alias("class_high"),
        ),
        "item-classes",
    )
    classes = per_window.select("class_low", "class_high", "ids").dropDuplicates(
        ["class_low", "class_high"]
    )
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # at most ``window``
    marks = own.select("mark").distinct()
    known = None
    if marks.count() <= sent:
        known = np.sort(np.array([r[0] for r in marks.collect()], np.int64))
    rows = keyed_text(docs, doc_id, text).mapInArrow(
        fingerprints(sizes, gram, known), FINGERPRINTS
    )
    if known is None:
        every = marks.unionByName(docs.sparkSession.range(1).select(F.lit(NO_MARK).alias("mark")))
        rows = rows.join(every, "mark", "left_semi")
    rows = settle(rows, "doc-fingerprints")
    counted = rows.where(F.col("mark") == NO_MARK).select(F.col("id").alias("doc_id"), "n_words")
    hits = (
        rows.where(F.col("mark") != NO_MARK)
        .select("id", "size", "mark", "first", F.posexplode("windows").alias("step", "window"))
        .join(per_window.drop("ids"), ["mark", "size", "window"])
        .select(
            F.col("id").alias("doc_id"),
            (F.col("first") + F.col("step")).alias("begin"),
            (F.col("first") + F.col("step") + F.col("size")).alias("end"),
            "class_low",
            "class_high",
        )
    )
    return counted, hits, classes


def spans_hit(hits: DataFrame) -> DataFrame:
    """(doc_id, spans): each document's hits joined to disjoint spans of words, in order."""
    ordered = F.sort_array(F.collect_set(F.struct("begin", "end")))
    return hits.groupBy("doc_id").agg(ordered.alias("hits")).select("doc_id", _joined("hits"))


def _joined(column: str):
    return F.expr(
        f"""aggregate({column}, cast(array() as array<struct<begin: bigint, end: bigint>>),
        (done, h) -> if(size(done) > 0 and h.begin <= element_at(done, -1).end,
            concat(slice(done, 1, size(done) - 1), array(named_struct(
                'begin', element_at(done, -1).begin,
                'end', greatest(element_at(done, -1).end, h.end)))),
            concat(done, array(named_struct('begin', h.begin, 'end', h.end)))))"""
    ).alias("spans")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 6, share: int = 20, **names
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item ids found, contaminated, spans.

    A document is contaminated when at least one of its words in ``share`` is hit.
    """
    counted, hits, classes = shared_windows(docs, items, window, gram, **names)
    hits = settle(hits, "hits")
    found = spans_hit(hits)
    ids = (
        hits.select("doc_id", "class_low", "class_high")
        .distinct()
        .join(classes, ["class_low", "class_high"])
        .select("doc_id", F.explode("ids").alias("item"))
        .distinct()
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    )
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)")
    return (
        counted.join(found.join(ids, "doc_id"), "doc_id", "left")
        .withColumn("n_hit", F.coalesce(hit, F.lit(0).cast("bigint")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn(
            "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
        )
    )


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those found contaminated, all columns as given."""
    key = options.get("doc_id", "doc_id")
    bad = contamination(docs, items, **options).where("contaminated").select(
        F.col("doc_id").alias(key)
    )
    # never by broadcast, so that the plan is the same whatever the number found
    return docs.join(settle(bad, "contaminated").hint("merge"), key, "left_anti")
