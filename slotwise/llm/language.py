"""Language identification by compression.

For each language the library keeps a raw-content zstandard dictionary of its text. A text is
encoded with every dictionary, and the language whose dictionary makes it smallest is chosen; when
the runner-up is nearly as small, the text is rejected. Text is put in small letters and every run
of other characters than letters becomes one space, so that digits, mark-up and capitals cannot
decide. The whole text is encoded, in blocks short enough for the dictionary to matter in each.

Defined results: a null text and one without any letter is ``und`` with score 0, and rejected; if no
language was learned, so is every text; when two languages are equally small, the first by name is
chosen, with score 0, and the text is rejected; repeated rows get the same answer each. Further
columns are ignored, or kept by :func:`accepted`.
"""

import re
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.frames import fresh, table

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Bytes of text that a dictionary is made of, at most. The only bound on what is learned from.
DICTIONARY_BYTES = 128 * 1024
#: Rows of one language that are looked at to fill a dictionary, in the mean.
SAMPLE_ROWS = 256
#: Texts longer than this are not taken into a dictionary, as one would fill it.
SAMPLE_BYTES = 16 * 1024
#: Bytes encoded at once.
BLOCK = 2048
LEVEL = 3
#: A shorter text is encoded from each of its first places, as one size alone is too coarse, at a
#: level that looks harder, and behind a filler, so that the encoder never falls back to storing it.
SHORT, SHIFTS, SHORT_LEVEL = 256, 8, 12
FILLER = b"0" * 64 + b" "
#: The share of the runner-up's size by which the smallest must be smaller.
MARGIN = 0.01


@dataclass(frozen=True)
class LanguageModel:
    """A dictionary for each language; its size is bounded by the number of languages."""

    dictionaries: dict[str, bytes]


def letters_only(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def learn(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> LanguageModel:
    """Dictionaries from a bounded sample of the rows with text and language.

    Rows are drawn by a hash of their key: about SAMPLE_ROWS of each language, whatever the
    number of rows, of which whole texts up to ``dictionary_bytes`` are used.
    """
    rows = (
        table(labelled, text=text, lang=lang, key=key)
        .where("text is not null and lang is not null")
        .where(F.octet_length("text").between(1, SAMPLE_BYTES))
    )
    # one row for each language; a model holds a dictionary for each in any case
    sizes = {r.lang: r.rows for r in rows.groupBy("lang").agg(F.count("text").alias("rows")).collect()}
    if not sizes:
        return LanguageModel({})
    share = F.create_map(*[F.lit(x) for pair in sizes.items() for x in (pair[0], float(pair[1]))])
    draw = F.pmod(F.xxhash64(F.col("key"), F.col("text")), F.lit(1 << 40)) / F.lit(1 << 40)
    drawn = rows.withColumn("draw", draw).where(F.col("draw") * share[F.col("lang")] < SAMPLE_ROWS)
    held: dict[str, bytearray] = {}
    seen: set[str] = set()
    for row in drawn.select("lang", "draw", "text").orderBy("lang", "draw", "text").collect():
        have = held.setdefault(row.lang, bytearray())
        if len(have) < dictionary_bytes and row.text not in seen:
            seen.add(row.text)
            have += letters_only(row.text) + b" "
    return LanguageModel({k: bytes(v[:dictionary_bytes]) for k, v in held.items() if len(v) >= 8})


def _encoders(model: LanguageModel, level: int) -> list:
    found = []
    for name in sorted(model.dictionaries):
        held = zstandard.ZstdCompressionDict(
            model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        held.precompute_compress(level=level)
        found.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False))
    return [f.compress for f in found]


class Encoders:
    """The encoders of each language, in order of name."""

    def __init__(self, model: LanguageModel):
        self.names = sorted(model.dictionaries)
        self.long, self.short = _encoders(model, LEVEL), _encoders(model, SHORT_LEVEL)

    def sizes(self, text: str | None) -> list[int] | None:
        """Bytes of the text under each dictionary; None if it has no letter."""
        raw = letters_only(text) if text else b""
        if not raw:
            return None
        if len(raw) < SHORT:
            parts = [FILLER + raw[i:] + b" " for i in range(min(SHIFTS, len(raw)))]
            return [sum(len(encode(p)) for p in parts) for encode in self.short]
        parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(encode(p)) for p in parts) for encode in self.long]

    def decide(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected); the score is the share saved against the runner-up."""
        sizes = self.sizes(text) if self.names else None
        if sizes is None:
            return UNKNOWN, 0.0, True
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else 2 * best
        score = (second - best) / second
        return self.names[order[0]], score, score < margin


def classify(model: LanguageModel, margin: float = MARGIN):
    """A function of a text column: struct of lang, score and rejected."""
    kept: list[Encoders] = []

    @F.pandas_udf("lang string, score double, rejected boolean")
    def decide(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(Encoders(model))
        rows = [kept[0].decide(t, margin) for t in texts]
        return pd.DataFrame(rows, columns=["lang", "score", "rejected"])

    return decide


def identify(
    docs: DataFrame, model: LanguageModel, margin: float = MARGIN,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every document."""
    found = classify(model, margin)(F.col("text"))
    return table(docs, doc_id=doc_id, text=text).select("doc_id", found.alias("found")).select(
        "doc_id", F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected"
    )


def accepted(
    docs: DataFrame, model: LanguageModel, margin: float = MARGIN, text: str = "text"
) -> DataFrame:
    """``docs`` without those that are rejected, all columns as given."""
    mark = fresh("language")
    found: Column = classify(model, margin)(F.col(text))
    return docs.withColumn(mark, found).where(f"not {mark}.rejected").drop(mark)
