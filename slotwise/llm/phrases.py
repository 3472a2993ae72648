"""Phrases of two and three words that occur together more often than their parts would explain.

Counting goes by direct addresses. Words are ranked by frequency; a pair of ranks is a cell of a
square tile. A task counts a tile that many of its pairs fall into as a dense array (``bincount``), and
the pairs of all other tiles as sorted coordinates; Spark adds the tasks' figures up. Pairs that
are frequent enough are ranked in their turn and take the place of the first word: a phrase of
three words is a cell of (pair, word). A phrase can only be frequent if its parts are.

Tasks hold the ranks of the ``HEAD`` most frequent words and pairs, a fixed number. If more are frequent,
phrases that hold another one are counted under their text, so nothing is lost; ``BITS`` bits tell
most of the rare ones beforehand.

Defined results: words are lower-cased (ASCII), lie between blanks, and no phrase crosses one of
``. , ; : ! ?`` or an end of a line; a null text has no words; rows without a language are one
language (``und``), together with rows that say so; a table without words gives no rows. Repeated
rows and ids count each. Words and pairs are told apart by 64-bit hashes where they are looked up.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm import spans
from slotwise.llm.frames import discard, settle, table
from slotwise.llm.shingles import pieces
from slotwise.operators.ranks import row_places

NO_LANGUAGE = "und"
LEAST = 10
TOP = 2000
#: Words, and pairs, whose ranks every task holds.
HEAD = 1 << 21
#: Bits that tell frequent words, and pairs, without a rank. Full bits let rare ones be counted too.
BITS = 1 << 27
#: Side of a tile; share of its cells that makes it dense; tiles that may be, along either side.
SIDE, DENSE, GRID = 256, 1 / 16, 8
#: Bytes of text looked at together; a longer text is cut between pieces.
AT_ONCE = 1 << 20

# What ends a piece, and what ends a word within one.
_ENDS = spans.byte_table([*b".,;:!?", *range(0x0A, 0x0E)])
_IS_WORD = ~(_ENDS | spans.byte_table([0x20, 0x09]))


@dataclass
class Found:
    """Words of one stretch of text, in order."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lang: np.ndarray  # which language of ``langs``
    key: np.ndarray  # hash of language and word
    follows: np.ndarray  # whether the next word is in the same piece


def language_keys(langs: pa.Array) -> np.ndarray:
    raw, offsets = spans.text_bytes(langs)
    return spans.range_hashes(spans.BYTE_VALUES[raw], offsets[:-1], offsets[1:])


def keys_of(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return spans.mix(words + spans.mix(langs))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return spans.mix(first * np.uint64(0x9E3779B97F4A7C15) + spans.mix(second))


def _stretches(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``AT_ONCE`` that end where a piece or a text ends."""
    at, size = 0, len(raw)
    while at < size:
        end = min(size, at + AT_ONCE)
        while end < size and not _ENDS[raw[end - 1]]:
            ahead = raw[end : end + AT_ONCE]
            hit = np.flatnonzero(_ENDS[ahead])
            text = offsets[np.searchsorted(offsets, end)]
            stop = end + int(hit[0]) + 1 if len(hit) else end + len(ahead)
            if text <= stop:
                end = int(text)
                break
            end = stop
        yield at, end
        at = end


def find(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Found]]:
    """(languages, words) of stretches of (lang, text) rows."""
    for part in pieces([batch]):
        coded = pc.dictionary_encode(part.column(0).cast(pa.string()).fill_null(NO_LANGUAGE))
        raw, offsets = spans.text_bytes(part.column(1))
        salts = language_keys(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        for lo, hi in _stretches(raw, offsets):
            own = spans.LOWER[raw[lo:hi]]
            edge = np.unique(np.clip(offsets, lo, hi)) - lo
            words = spans.find_words(own, edge, _IS_WORD)
            if not len(words.starts):
                continue
            text = np.searchsorted(offsets, words.starts + lo, "right") - 1
            ended = np.cumsum(_ENDS[own], dtype=np.int32)[words.starts]
            follows = np.zeros(len(text), bool)
            follows[:-1] = (text[1:] == text[:-1]) & (ended[1:] == ended[:-1])
            hashes = spans.range_hashes(spans.BYTE_VALUES[own], words.starts, words.ends)
            lang = code[text]
            yield coded.dictionary, Found(
                own, words.starts, words.ends, lang, keys_of(hashes, salts[lang]), follows
            )


def _texts(found: Found, first: np.ndarray, size: int = 1) -> pa.Array:
    """The ``size`` words from each of ``first`` on, with one blank between."""
    word = (first[:, None] + np.arange(size)).ravel()
    own = found.ends[word] - found.starts[word]
    room = own + 1
    room[size - 1 :: size] -= 1
    ends = np.concatenate([[0], np.cumsum(room)])
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], room)
    data = found.raw[np.minimum(np.repeat(found.starts[word], room) + place, len(found.raw) - 1)]
    data[place == np.repeat(own, room)] = 0x20
    offsets = pa.py_buffer(ends[::size].astype(np.int32))
    return pa.StringArray.from_buffers(len(first), offsets, pa.py_buffer(data))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, times) of (lang, text) rows; each stretch is counted where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, found in find(batch):
                _, first, times = np.unique(found.key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(found.lang[first])), _texts(found, first), pa.array(times)],
                    ["lang", "word", "times"],
                )

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word string, times bigint")
    return counted.groupBy("lang", "word").agg(F.sum("times").alias("times"))


#: What :meth:`Ranks.find` says of keys without a rank.
RARE, MAYBE = -1, -2


@dataclass
class Ranks:
    """Hashes of the most frequent in order, with their ranks, and bits that tell other frequent ones."""

    keys: np.ndarray
    ranks: np.ndarray
    bits: np.ndarray | None  # None if all that is frequent has a rank

    @classmethod
    def of(cls, keys: np.ndarray, bits: np.ndarray | None) -> "Ranks":
        order = np.argsort(keys)
        return cls(keys[order], order.astype(np.int64), bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key; ``RARE`` if it is surely not frequent, else ``MAYBE``."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = np.where(self.keys[at] == keys, self.ranks[at], RARE)
        else:
            found = np.full(len(keys), RARE, np.int64)
        if self.bits is not None:
            held = np.ones(len(keys), bool)
            for word, bit in _bits_of(keys):
                held &= (self.bits[word] >> bit) & np.uint64(1) > 0
            found[held & (found == RARE)] = MAYBE
        return found


def _bits_of(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two places of each key among ``BITS``, as word and bit."""
    places = [keys % np.uint64(BITS), (keys >> np.uint64(32)) % np.uint64(BITS)]
    return [((p >> np.uint64(6)).astype(np.int64), p & np.uint64(63)) for p in places]


@dataclass
class Tiles:
    """Counts of (first, second) ranks, dense for tiles that fill up."""

    dense: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts cells of dense tiles here, and returns (cell, times) of all others in order."""
        near = np.flatnonzero((first < GRID * SIDE) & (second < GRID * SIDE))
        tile = (first[near] // SIDE) * GRID + second[near] // SIDE
        times = np.bincount(tile, minlength=GRID * GRID)
        for k in np.flatnonzero(times >= DENSE * SIDE * SIDE):
            self.dense.setdefault(int(k), np.zeros(SIDE * SIDE, np.int64))
        rest = np.ones(len(first), bool)
        for k, counts in self.dense.items():
            if times[k]:
                inside = near[tile == k]
                place = (first[inside] % SIDE) * SIDE + second[inside] % SIDE
                counts += np.bincount(place, minlength=SIDE * SIDE)
                rest[inside] = False
        return np.unique((first[rest] << 32) | second[rest], return_counts=True)

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for tile, counts in self.dense.items():
            held = np.flatnonzero(counts)
            first = (tile // GRID) * SIDE + held // SIDE
            second = (tile % GRID) * SIDE + held % SIDE
            yield (first << 32) | second, counts[held]


_COUNTED = "cell bigint, lang string, phrase string, times bigint"


def _cells(cells: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(cells), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(cells), none, none, pa.array(times)], ["cell", "lang", "phrase", "times"]
    )


def _spelled(langs: pa.Array, found: Found, first: np.ndarray, size: int) -> pa.RecordBatch:
    """Phrases that hold something without a rank, under their text."""
    key = found.key[first]
    for k in range(1, size):
        key = pair_keys(key, found.key[first + k])
    _, one, times = np.unique(key, return_index=True, return_counts=True)
    at = first[one]
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(len(at), pa.int64()),
            langs.take(pa.array(found.lang[at])),
            _texts(found, at, size),
            pa.array(times),
        ],
        ["cell", "lang", "phrase", "times"],
    )


def _summed(counted: DataFrame, whole: bool, least: int) -> DataFrame:
    """Frequent phrases; without spelled ones the cell alone tells them apart."""
    by = ["cell"] if whole else ["cell", "lang", "phrase"]
    total = counted.groupBy(*by).agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    if whole:
        none = F.lit(None).cast("string")
        total = total.select("cell", none.alias("lang"), none.alias("phrase"), "times")
    return total


def pair_counts(docs: DataFrame, words: Broadcast, least: int) -> DataFrame:
    """(cell, lang, phrase, times) of frequent pairs; a cell is two ranks, a phrase has none."""
    whole = words.value.bits is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, tiles = words.value, Tiles()
        for batch in batches:
            for langs, found in find(batch):
                rank = ranks.find(found.key)
                at = np.flatnonzero(found.follows)
                one, two = rank[at], rank[np.minimum(at + 1, len(rank) - 1)]
                known = (one >= 0) & (two >= 0)
                yield _cells(*tiles.add(one[known], two[known]))
                if not whole:
                    yield _spelled(langs, found, at[~known & (one != RARE) & (two != RARE)], 2)
        for cells, times in tiles.cells():
            yield _cells(cells, times)

    return _summed(docs.select("lang", "text").mapInArrow(run, _COUNTED), whole, least)


def triple_counts(docs: DataFrame, words: Broadcast, pairs: Broadcast, least: int) -> DataFrame:
    """As :func:`pair_counts` for three words: a cell is the rank of a pair and that of a word."""
    whole = words.value.bits is None and pairs.value.bits is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, paired, tiles = words.value, pairs.value, Tiles()
        for batch in batches:
            for langs, found in find(batch):
                # the rank of the pair that begins at each word, where one does
                pair = np.full(len(found.key), RARE)
                at = np.flatnonzero(found.follows)
                pair[at] = paired.find(pair_keys(found.key[at], found.key[at + 1]))
                at = np.flatnonzero((pair[:-1] != RARE) & (pair[1:] != RARE))
                word = ranks.find(found.key[at + 2])
                known = (pair[at] >= 0) & (word >= 0)
                yield _cells(*tiles.add(pair[at][known], word[known]))
                if not whole:
                    yield _spelled(langs, found, at[~known], 3)
        for cells, times in tiles.cells():
            yield _cells(cells, times)

    return _summed(docs.select("lang", "text").mapInArrow(run, _COUNTED), whole, least)


def _row_keys(rows: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """The hash of each row's language and words, as :func:`find` makes it."""

    if not rows.num_rows:
        return np.zeros(0, np.uint64)
    langs, found = language_keys(rows.column("lang").cast(pa.string())), None
    for name in names:
        raw, offsets = spans.text_bytes(rows.column(name).cast(pa.string()))
        own = keys_of(spans.range_hashes(spans.BYTE_VALUES[raw], offsets[:-1], offsets[1:]), langs)
        found = own if found is None else pair_keys(found, own)
    return found


def ranked(frequent: DataFrame, names: list[str], head: int, name: str) -> tuple[DataFrame, Ranks]:
    """The ``head`` most frequent rows with their ranks, and what tasks are given of all rows."""
    order = [F.desc("times"), "lang", *names]
    placed = row_places(frequent.withColumn("all", F.lit("")), ["all"], order, f"{name}-placed")
    placed = settle(placed.select("lang", *names, F.col("_nr").alias("rank")), f"{name}-ranked")
    first = placed.where(F.col("rank") < head)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array(_row_keys(batch, names).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("rank"), own], ["rank", "key"])

    found = first.mapInArrow(keyed, "rank bigint, key bigint").toArrow()
    keys = np.zeros(found.num_rows, np.uint64)
    keys[found.column("rank").to_numpy()] = found.column("key").to_numpy().view(np.uint64)
    rest = placed.where(F.col("rank") >= head)
    bits = None if rest.isEmpty() else _told(rest, names)
    return first, Ranks.of(keys, bits)


def _told(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Bits that are set for every row's key; each task sends the words it set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BITS // 64, np.uint64)
        for batch in batches:
            for word, bit in _bits_of(_row_keys(batch, names)):
                np.bitwise_or.at(own, word, np.uint64(1) << bit)
        held = np.flatnonzero(own)
        for lo in range(0, len(held), 1 << 16):
            part = held[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own[part].view(np.int64))], ["word", "bits"])

    each = rows.select("lang", *names).mapInArrow(run, "word bigint, bits bigint")
    found = each.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def _spell(counted: DataFrame, first: DataFrame, second: DataFrame, words: list[str]) -> DataFrame:
    """(lang, words..., times) of cells and spelled phrases; ``first`` names the cell's upper rank."""
    lead = words[:-1]
    upper = first.select(F.col("lang").alias("_lang"), *lead, F.col("rank").alias("_first"))
    lower = second.select(F.col("word").alias(words[-1]), F.col("rank").alias("_second"))
    cells = counted.where("cell is not null").select(
        F.shiftright("cell", 32).alias("_first"), F.col("cell").bitwiseAND(0xFFFFFFFF).alias("_second"), "times"
    )
    named = cells.join(upper, "_first").join(lower, "_second").select(
        F.col("_lang").alias("lang"), *words, "times"
    )
    part = F.split("phrase", " ")
    spelled = counted.where("cell is null").select(
        "lang", *[part[k].alias(w) for k, w in enumerate(words)], "times"
    )
    return named.unionByName(spelled)


def _score(whole: str, left: str, right: str):
    return F.expr(
        f"(cast(1000000 as decimal(7,0)) * cast({whole} as decimal(15,0)) * cast({whole} as decimal(15,0)))"
        f" div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))"
    )


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    head: int = HEAD,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    Of all ways to cut a phrase in two the one of least score counts, the earliest of equals. Phrases of
    which half or more stand inside one longer frequent phrase are left out.
    """
    spark = docs.sparkSession
    own = table(docs, lang=lang, text=text)
    with discard(spark) as keep:
        words = settle(word_counts(own), "words")
        totals = words.groupBy("lang").agg(F.sum("times").alias("n"))
        frequent = settle(words.where(F.col("times") >= least), "words-frequent")
        named, found = ranked(frequent, ["word"], head, "words")
        ranks = spark.sparkContext.broadcast(found)
        counted = settle(pair_counts(own, ranks, least), "pair-cells")
        first = named.withColumnRenamed("word", "w1")
        pairs = settle(_spell(counted, first, named, ["w1", "w2"]), "pairs")
        paired, found = ranked(pairs, ["w1", "w2"], head, "pairs")
        pair_ranks = spark.sparkContext.broadcast(found)
        counted = settle(triple_counts(own, ranks, pair_ranks, least), "triple-cells")
        triples = settle(_spell(counted, paired, named, ["w1", "w2", "w3"]), "triples")

        def of_word(name: str, out: str) -> DataFrame:
            return frequent.select("lang", F.col("word").alias(name), F.col("times").alias(out))

        def of_pair(a: str, b: str, out: str) -> DataFrame:
            return pairs.select("lang", F.col("w1").alias(a), F.col("w2").alias(b), F.col("times").alias(out))

        inside = (
            triples.select("lang", "w1", "w2", "times")
            .unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "times"))
            .groupBy("lang", "w1", "w2")
            .agg(F.max("times").alias("longer"))
        )
        two = (
            pairs.join(of_word("w1", "l"), ["lang", "w1"])
            .join(of_word("w2", "r"), ["lang", "w2"])
            .join(inside, ["lang", "w1", "w2"], "left")
            .where("longer is null or 100 * longer < 50 * times")
            .select(
                "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("times").alias("a"), "l", "r",
                _score("times", "l", "r").alias("score"),
            )
        )
        cuts = (
            triples.join(of_word("w1", "l1"), ["lang", "w1"])
            .join(of_pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
            .join(of_pair("w1", "w2", "l2"), ["lang", "w1", "w2"])
            .join(of_word("w3", "r2"), ["lang", "w3"])
            .withColumns({"s1": _score("times", "l1", "r1"), "s2": _score("times", "l2", "r2")})
        )
        early = F.col("s1") <= F.col("s2")
        three = cuts.select(
            "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("times").alias("a"),
            F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
            F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"),
            F.least("s1", "s2").alias("score"),
        )
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        listed = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        found = listed.join(totals, "lang").select(
            "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
        )
        found = keep(settle(found, "collocations"))
        ranks.unpersist()
        pair_ranks.unpersist()
        return found
