"""Quality rules on text statistics, with DataFrame functions only.

Fixed rules come first: texts of few words, or with many words in repeated windows, fail. The
others get a vector of transformed statistics. For each language and source the minimum covariance
determinant gives a centre and a scatter that junk cannot move: from robust starts, concentration
steps keep the share of vectors nearest by Mahalanobis distance and estimate anew from these, and
the start that ends with the least determinant wins. A text whose distance exceeds the cutoff is
rejected.

All texts take part in the estimates. A step gathers sums of products and a quantile sketch for each
group, so a group of any size is reduced where its rows lie. Scatter gets a floor for each statistic,
because most texts agree fully in some of them; the floor is also what makes scatter invertible.

Defined results: a null text has no words; it and texts of fewer than ten words fail the fixed rules; a
null language or source is a value of its own; groups of fewer than ``least_rows`` vectors are
estimated together, and if these are still fewer, the method keeps them; repeated rows count each.
Further columns are ignored.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.frames import settle, table

BLANK = r"[\x20\x09-\x0D]+"
HOLDS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Statistics of a vector, each with the least spread it is credited with.
FLOORS = {
    "words": 0.05,
    "distinct": 0.3,
    "letters": 0.1,
    "symbols": 0.5,
    "capitals": 0.4,
    "repeated": 1.0,
    "doubled": 1.0,
}
NAMES = tuple(FLOORS)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
#: Share of a group that a concentration step keeps.
KEPT_SHARE = 0.7
STEPS = 5
LEAST_ROWS = 70
#: Squared distance beyond which a vector is rejected, and the median of a squared distance of
#: normal vectors of this length.
CUTOFF, MEDIAN = 60.0, 6.346
ACCURACY = 2000


def _times(pattern: str, text: Column) -> Column:
    """Characters of a text in matches of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (id, lang, source, text) with counts for each text in place of the text."""
    text = F.coalesce("text", F.lit(""))
    pieces = docs.select(
        "id",
        "lang",
        "source",
        F.filter(F.split(text, BLANK), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HOLDS_WORD)).alias("lines"),
        F.length(F.regexp_replace(text, BLANK, "")).alias("word_chars"),
        _times(SYMBOLS, text).alias("n_symbols"),
        _times("[A-Z]+", text).alias("n_capitals"),
    )
    hashed = pieces.select(
        "id",
        "lang",
        "source",
        "word_chars",
        "n_symbols",
        "n_capitals",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("marks"),
    )
    counted = hashed.withColumns(
        {
            "n_words": F.size("marks"),
            "n_distinct": F.size(F.array_distinct("marks")),
            "windows": F.expr(
                f"""transform(if(size(marks) < {WINDOW}, cast(array() as array<int>),
                    sequence(0, size(marks) - {WINDOW})), i -> xxhash64(
                    {", ".join(f"marks[i + {k}]" for k in range(WINDOW))}))"""
            ),
        }
    ).drop("marks")
    # only texts with a repeated window sort them
    sorted_ = counted.withColumn(
        "ordered",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.expr("transform(windows, (w, i) -> named_struct('w', w, 'i', i))")),
        ),
    ).drop("windows")
    places = sorted_.withColumn(
        "places",
        F.expr(
            """array_sort(transform(filter(sequence(0, size(ordered) - 1), k ->
                (k > 0 and ordered[k].w = ordered[k - 1].w)
                or (k < size(ordered) - 1 and ordered[k].w = get(ordered, k + 1).w)),
                k -> ordered[k].i))"""
        ),
    ).drop("ordered")
    covered = F.expr(
        f"""aggregate(transform(places, (p, k) ->
            least({WINDOW}, coalesce(get(places, k + 1) - p, {WINDOW}))), 0, (a, b) -> a + b)"""
    )
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_distinct", "n_capitals")
    return places.select(
        "id",
        "lang",
        "source",
        *[F.col(c).cast("long").alias(c) for c in numbers],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def vectors(counts: DataFrame) -> DataFrame:
    """(id, lang, source, v0 ...): logarithms of the counts."""
    of = {
        "words": F.col("n_words"),
        "distinct": F.col("n_distinct"),
        "letters": F.col("word_chars"),
        "symbols": F.col("n_symbols"),
        "capitals": F.col("n_capitals"),
        "repeated": F.col("n_repeat_words"),
        "doubled": F.col("n_dup_lines"),
    }
    return counts.select(
        "id", "lang", "source", *[F.log1p(of[n].cast("double")).alias(f"v{i}") for i, n in enumerate(NAMES)]
    )


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def whitened(estimates: DataFrame) -> DataFrame:
    """``estimates`` (m*, s*_*) with the inverse of the scatter's Cholesky factor and log_det."""
    size = range(len(NAMES))
    out = estimates
    for j in size:
        for i in range(j, len(NAMES)):
            rest = F.col(f"s{i}_{j}")
            if j:
                rest = rest - _sum(F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j))
            if i == j:
                out = out.withColumn(f"l{i}_{i}", F.sqrt(F.greatest(rest, F.lit(1e-9))))
            else:
                out = out.withColumn(f"l{i}_{j}", rest / F.col(f"l{j}_{j}"))
    for i in size:
        for j in range(i + 1):
            if i == j:
                out = out.withColumn(f"w{i}_{i}", 1 / F.col(f"l{i}_{i}"))
            else:
                held = _sum(F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i))
                out = out.withColumn(f"w{i}_{j}", -held / F.col(f"l{i}_{i}"))
    return out.select(
        "part",
        "start",
        *[f"m{i}" for i in size],
        *[f"w{i}_{j}" for i, j in PAIRS],
        (2 * _sum(F.log(f"l{i}_{i}") for i in size)).alias("log_det"),
    )


def squared_distance() -> Column:
    rows = (
        _sum(F.col(f"w{i}_{j}") * (F.col(f"v{j}") - F.col(f"m{j}")) for j in range(i + 1))
        for i in range(len(NAMES))
    )
    return _sum(r * r for r in rows)


def _moments(rows: DataFrame, *key: str) -> DataFrame:
    """Means and floored covariances of the vectors of each key."""
    size = range(len(NAMES))
    sums = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"v{i}").alias(f"a{i}") for i in size],
        *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"b{i}_{j}") for i, j in PAIRS],
    )
    means = [(F.col(f"a{i}") / F.col("n")).alias(f"m{i}") for i in size]
    scatter = [
        (
            F.col(f"b{i}_{j}") / F.col("n")
            - F.col(f"a{i}") / F.col("n") * F.col(f"a{j}") / F.col("n")
            + F.lit(FLOORS[NAMES[i]] ** 2 if i == j else 0.0)
        ).alias(f"s{i}_{j}")
        for i, j in PAIRS
    ]
    return sums.select(*key, *means, *scatter)


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts for each part: medians with the spread of quartiles, and the plain moments."""
    size = range(len(NAMES))
    quartiles = rows.groupBy("part").agg(
        *[
            F.percentile_approx(f"v{i}", [0.25, 0.5, 0.75], ACCURACY).alias(f"q{i}")
            for i in size
        ]
    )
    spread = [
        F.lit(0.0)
        if i != j
        else F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[NAMES[i]] ** 2
        for i, j in PAIRS
    ]
    robust = quartiles.select(
        "part",
        F.lit(0).alias("start"),
        *[F.col(f"q{i}")[1].alias(f"m{i}") for i in size],
        *[s.alias(f"s{i}_{j}") for s, (i, j) in zip(spread, PAIRS, strict=True)],
    )
    plain = _moments(rows, "part").withColumn("start", F.lit(1))
    return robust.unionByName(plain)


def minimum_covariance(rows: DataFrame, steps: int = STEPS, share: float = KEPT_SHARE) -> DataFrame:
    """(part, m*, w*_*, scale): robust centre, whitening and scale of the vectors of each part."""
    state = settle(whitened(_starts(rows)), "mcd-start")

    def spread(state: DataFrame, share: float) -> DataFrame:
        return (
            rows.join(state, "part")
            .groupBy("part", "start")
            .agg(F.percentile_approx(squared_distance(), share, ACCURACY).alias("reach"))
        )

    for _ in range(steps):
        reach = settle(state.join(spread(state, share), ["part", "start"]), "mcd-reach")
        near = rows.join(reach, "part").where(squared_distance() <= F.col("reach"))
        state = settle(whitened(_moments(near, "part", "start")), "mcd-step")
    least = state.groupBy("part").agg(F.min(F.struct("log_det", "start")).alias("best"))
    best = state.join(least.select("part", F.col("best.start").alias("start")), ["part", "start"])
    best = settle(best, "mcd-best")
    middle = spread(best, 0.5).select("part", (F.col("reach") / MEDIAN).alias("scale"))
    return best.drop("start", "log_det").join(middle, "part")


def judged(
    docs: DataFrame,
    cutoff: float = CUTOFF,
    least_rows: int = LEAST_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """doc_id, the counts, base_failed, distance (squared, of those estimated) and kept."""
    given = table(docs, id=doc_id, text=text, lang=lang, source=source)
    counts = settle(statistics(given).withColumn("base_failed", failed()), "statistics")
    passed = vectors(counts.where("not base_failed"))
    sizes = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    # parts are numbered by name: the pair itself, or one part for all small pairs
    name = F.to_json(F.struct("lang", "source"))
    parts = sizes.select(
        F.col("lang").alias("l"),
        F.col("source").alias("s"),
        F.when(F.col("rows") >= least_rows, name).otherwise("rest").alias("part"),
    )
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    rows = settle(
        passed.join(settle(parts, "parts"), same).select("id", "part", *[f"v{i}" for i in range(len(NAMES))]),
        "vectors",
    )
    large = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)
    # written before anything groups it by part, so that the join may split a part
    large = settle(large.select("part"), "large-parts")
    estimated = settle(rows.join(large, "part", "left_semi"), "estimated")
    found = settle(minimum_covariance(estimated), "mcd")
    far = estimated.join(found, "part").select(
        "id", (squared_distance() / F.greatest("scale", F.lit(1.0))).alias("distance")
    )
    far = far.groupBy("id").agg(F.max("distance").alias("distance"))
    return (
        counts.join(far, "id", "left")
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))
        .withColumnRenamed("id", "doc_id")
    )
