"""Sources mixed to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are summed to cells of (source, language, topic). The cells' token weights are raked: in
each round they are scaled to meet the target share of every source, then of every language, then of
every topic. A cell's rate is its raked weight over its tokens, scaled to the budget. A document is
drawn with its cell's rate, or with certainty and a weight above one where the rate is above
one, so that drawn tokens times weight meet the targets in the mean.

Defined results: a null value of a dimension is a value of its own; a null or empty text has no
tokens, takes no part in the raking and gets its cell's rate, or 0 if its cell has no tokens; a
value that a target does not list has the share 0 and its documents are not drawn; target shares need
not add up to one; repeated rows with one id are drawn together; an empty table gives an empty one.
Documents keep their further columns in :func:`mixed`.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.frames import fresh, settle

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 12
#: Rounds planned together; each lot of rounds is one job over the cells.
LOT = 3
#: Share of the tokens that the mix should hold.
BUDGET = 0.5
#: Shares go as the observed ones to this power, unless targets are given.
FLATTEN = 0.5
#: Bytes of text that count as a token.
TOKEN_BYTES = 4


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.ceil(F.octet_length(text) / TOKEN_BYTES), F.lit(0)).cast("long")


def form_of(text: Column) -> Column:
    """A stand-in for a topic where documents have none: the form of the text."""
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("###")) | F.contains(text, F.lit("***")), "symbols")
        .when(F.octet_length(text) < 400, "short")
        .otherwise("prose")
    )


def flattened(cells: DataFrame, dimension: str, power: float = FLATTEN) -> DataFrame:
    """(value, share): observed token totals of a dimension to the given power."""
    totals = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens"))
    return totals.where("tokens > 0").select(
        "value", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("share")
    )


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def raked(
    cells: DataFrame, targets: Mapping[str, DataFrame] | None = None, rounds: int = ROUNDS
) -> DataFrame:
    """(source, lang, topic, tokens, w): w adds up to one and meets the targets, the last of them
    exactly and the others as closely as the rounds allow."""
    targets = targets or {}
    state = cells.where("tokens > 0").withColumn("w", F.col("tokens").cast("double"))
    for dimension in DIMENSIONS:
        goal = targets.get(dimension)
        goal = flattened(cells, dimension) if goal is None else goal
        goal = settle(goal, f"target-{dimension}")
        whole = goal.agg(F.sum("share")).first()[0] or 1.0
        goal = goal.select(
            F.col("value").alias(f"v_{dimension}"),
            (F.col("share") / F.lit(float(whole))).alias(f"t_{dimension}"),
        )
        state = state.join(
            goal,
            F.col(dimension).eqNullSafe(F.col(f"v_{dimension}")),
            "left",
        ).drop(f"v_{dimension}")
        state = state.fillna(0.0, [f"t_{dimension}"])
    state = settle(state, "cells")
    for at in range(0, rounds, LOT):
        for _ in range(at, min(at + LOT, rounds)):
            for dimension in DIMENSIONS:
                total = F.sum("w").over(Window.partitionBy(dimension))
                state = state.withColumn(
                    "w",
                    F.when(total > 0, F.col("w") * F.col(f"t_{dimension}") / total).otherwise(0.0),
                )
        state = settle(state, "raked")
    return state.select(*DIMENSIONS, "tokens", "w")


def rates(cells: DataFrame, budget: float = BUDGET, **options) -> DataFrame:
    """(source, lang, topic, rate): drawn weight of a token of each cell."""
    weights = raked(cells, **options)
    tokens, whole = weights.agg(F.sum("tokens"), F.sum("w")).first()
    if not whole:
        return weights.select(*DIMENSIONS, F.lit(0.0).alias("rate"))
    rate = F.col("w") * F.lit(tokens * budget) / (F.lit(whole) * F.col("tokens"))
    return weights.select(*DIMENSIONS, rate.alias("rate"))


def draw_of(doc_id: Column, salt: str = "mix") -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    digits = F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(f"-{salt}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topic: Column | None = None,
    budget: float = BUDGET,
    **options,
) -> DataFrame:
    """``docs`` with tokens, topic, probability, weight and sampled; columns of those names are
    replaced. ``sampled`` says whether the document is drawn."""
    topic = form_of(F.col(text)) if topic is None else topic
    keys = {d: fresh(d) for d in DIMENSIONS}
    id_ = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.withColumns(
        {
            keys["source"]: F.col(source),
            keys["lang"]: F.col(lang),
            keys["topic"]: topic,
        }
    )
    counted = rows.select(
        *[F.col(keys[d]).alias(d) for d in DIMENSIONS], tokens_of(F.col(text)).alias("tokens")
    )
    cells = settle(cells_of(counted), "cells")
    found = settle(rates(cells, budget, **options), "rates")
    found = found.select(
        *[F.col(d).alias(f"{keys[d]}_c") for d in DIMENSIONS],
        F.col("rate").alias(f"{keys['topic']}_r"),
    )
    same = None
    for d in DIMENSIONS:
        test = F.col(keys[d]).eqNullSafe(F.col(f"{keys[d]}_c"))
        same = test if same is None else same & test
    rate = F.coalesce(F.col(f"{keys['topic']}_r"), F.lit(0.0))
    named = rows.join(found, same, "left").withColumns(
        {
            "tokens": tokens_of(F.col(text)),
            "topic": F.col(keys["topic"]),
            "probability": F.round(F.least(rate, F.lit(1.0)), 9),
            "weight": F.round(F.greatest(rate, F.lit(1.0)), 6),
        }
    )
    named = named.withColumn("sampled", draw_of(id_) < F.col("probability"))
    added = ("tokens", "topic", "probability", "weight", "sampled")
    return named.select(*[c for c in docs.columns if c not in added], *added)
