"""Repeated runs of lines, found by winnowing over line hashes, with DataFrame functions only.

The lines of a text are its pieces between line feeds that hold more than blanks. Every window of
``window`` consecutive lines selects its line of least hash (of equal ones the first); the selected
lines are the anchors, about half of all lines, and any run of at least ``window`` lines that two
places share is guaranteed to share an anchor. Each anchor carries the hashes of the lines around
it. Anchors are counted by their hash and those that occur once are dropped. The others are
extended: for each window that selected it, an anchor is met, by the lines before and behind it, with
the first place that has the same ones, and neighbouring windows join to runs of any length. Anchors
meet the first place of their extension only, never each other in pairs. Of all places of a window
the first in order of (document, line) stays; every line that a later place covers is deleted.

With ``words`` given, shorter runs go too once they hold that many words, and a text of fewer lines
than the window is one window, whatever its words: it goes where an earlier text has all its lines
and no others, or where its lines are such a long run of an earlier text.

Defined results: a null text stays null and an empty one empty; lines of blanks are never counted,
compared or deleted; a text of fewer lines than the window loses nothing unless ``words`` is given; a run that repeats
within a text is deleted there too; rows that repeat a document id are told apart by nothing, so
ids must be unique; rows with a null id stay as they are. Further columns stay untouched. Ties
cannot occur, as places are distinct.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.frames import fresh, keyed_text, settle

#: A line that takes part holds at least one character other than these blanks.
HOLDS_TEXT = r"[^\x20\x09-\x0D]"
#: Words that make a run of fewer lines than the window long enough to count as a passage.
PASSAGE = 50


def anchors(docs: DataFrame, window: int, words: int | None = None) -> DataFrame:
    """(id, place, mark, chosen, before, wide, narrow): one row for each selected line.

    ``chosen`` holds a number for each window that selected the line: its count of lines times
    ``window``, plus the line's place in it. ``wide`` and ``narrow`` hash the lines around, of which
    the first ``before`` come before the selected one.
    """
    held = (
        docs.where("id is not null and text is not null")
        .select(
            "id",
            F.filter(F.split("text", "\n", -1), lambda x: x.rlike(HOLDS_TEXT)).alias("held"),
        )
        .where(F.size("held") >= (window if words is None else 1))
        .select(
            "id",
            F.transform("held", lambda x: F.xxhash64(x)).alias("wide"),
            F.transform("held", lambda x: F.hash(x)).alias("narrow"),
            *(
                []
                if words is None
                else [F.transform("held", lambda x: F.regexp_count(x, F.lit(f"{HOLDS_TEXT}+"))).alias("words")]
            ),
        )
    )
    sizes = [window] if words is None else range(1, window + 1)
    selected = {f"of_{n}": F.expr(_selected(n, window, words)) for n in sizes}
    chosen = ", ".join(
        f"""transform(filter(sequence(0, {n - 1}), o -> get(of_{n}, p - o) = p), o -> {n * window} + o)"""
        for n in sizes
    )
    picked = f"""filter(transform(sequence(0, size(wide) - 1), p -> named_struct(
        'place', p, 'chosen', concat({chosen}))), x -> size(x.chosen) > 0)"""
    start = f"greatest(x.place - {window - 1}, 0)"
    around = f"{start} + 1, x.place - {start} + {window}"
    # the lines around are cut out inside, so that no row carries the hashes of a whole text
    every = f"""transform({picked}, x -> named_struct(
        'place', x.place, 'mark', wide[x.place], 'chosen', x.chosen, 'before', x.place - {start},
        'wide', slice(wide, {around}), 'narrow', slice(narrow, {around})))"""
    return held.withColumns(selected).select("id", F.explode(F.expr(every)).alias("a")).select("id", "a.*")


def _selected(lines: int, window: int, words: int | None) -> str:
    """For each window of ``lines`` lines of a text, the place of its least hash; -1 where it does not count."""
    least = f"slice(wide, s + 1, {lines})"
    place = f"s + cast(array_position({least}, array_min({least})) as int) - 1"
    if lines < window:
        total = " + ".join(f"words[s + {n}]" for n in range(lines))
        place = f"if(size(wide) = {lines} or {total} >= {words}, {place}, -1)"
    return f"""if(size(wide) < {lines}, cast(array() as array<int>),
        transform(sequence(0, greatest(size(wide) - {lines}, 0)), s -> {place}))"""


def extended(found: DataFrame, window: int) -> DataFrame:
    """(id, first, lines, mark, chosen, wide, narrow): the windows around each anchor, hashed."""
    each = found.select("id", "place", "mark", "before", "wide", "narrow", F.explode("chosen").alias("chosen"))
    lines, place = F.expr(f"chosen div {window}").cast("int"), F.col("chosen") % window
    begin = F.col("before") - place + 1
    return each.select(
        "id",
        (F.col("place") - place).alias("first"),
        lines.alias("lines"),
        "mark",
        "chosen",
        F.xxhash64(F.slice("wide", begin, lines)).alias("wide"),
        F.hash(F.slice("narrow", begin, lines)).alias("narrow"),
    )


def repeated_lines(docs: DataFrame, window: int = 3, words: int | None = None) -> DataFrame:
    """(id, drops): the numbers, in order, of the lines that a later place of a window covers.

    Counts of marks and first places are written before they are joined, so that a mark or a run
    that fills many places is split where it is joined.
    """
    every = anchors(docs, window, words)
    marks = every.groupBy("mark").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    marks = settle(marks.select("mark"), "line-marks")
    shared = settle(every.join(marks.hint("merge"), "mark", "left_semi"), "line-anchors")
    places = extended(shared, window)
    key = ["mark", "chosen", "wide", "narrow"]
    firsts = (
        places.groupBy(*key)
        .agg(F.min(F.struct("id", "first")).alias("origin"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .select(*key, F.col("origin.id").alias("home"), F.col("origin.first").alias("start"))
    )
    firsts = settle(firsts, "line-firsts")
    later = places.join(firsts.hint("merge"), key).where("id != home or first != start")
    covered = F.sequence(F.col("first"), F.col("first") + F.col("lines") - 1)
    return later.groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(covered)))).alias("drops")
    )


def drop_repeated_lines(
    docs: DataFrame,
    window: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int | None = None,
) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text``; all columns and rows stay."""
    id_, drops, pieces, held = (fresh(x) for x in ("id", "drops", "pieces", "held"))
    found = settle(repeated_lines(keyed_text(docs, doc_id, text), window, words), "repeated-lines")
    found = found.select(F.col("id").alias(id_), F.col("drops").alias(drops))
    # never by broadcast, so that the plan is the same whatever the number of repeats
    joined = docs.join(found.hint("merge"), docs[doc_id] == found[id_], "left").withColumn(
        pieces, F.when(F.col(drops).isNotNull(), F.split(F.col(text), "\n", -1))
    )
    # numbers of the pieces that are lines, in order; then those of all pieces that stay
    lines = F.filter(
        F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.col(pieces)[i].rlike(HOLDS_TEXT)
    )
    gone = F.transform(F.col(drops), lambda n: F.col(held)[n])
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
    left = F.array_join(F.transform(stay, lambda i: F.col(pieces)[i]), "\n")
    return (
        joined.withColumn(held, F.when(F.col(pieces).isNotNull(), lines))
        .withColumn(text, F.when(F.col(pieces).isNotNull(), left).otherwise(F.col(text)))
        .select(*docs.columns)
    )
