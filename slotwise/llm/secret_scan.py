"""Secrets in text: three fixed patterns, and strings that a vocabulary finds hard to spell.

Ordinary words and identifiers take few tokens for their length. A random string takes a token for
every two characters or fewer. Runs of key characters are put through a tiktoken vocabulary, and those
with few characters to a token are reported, unless they are a known digest or an identifier: a
hexadecimal digest, a UUID, a number, a path or name made of ordinary words.

Defined results: a null or empty text has no span; positions are code points, the end exclusive;
matches of one pattern never overlap, those of different kinds may; a run that touches a match of a
fixed pattern is not reported a second time; repeated rows get the same spans each. Further columns are
ignored.
"""

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.frames import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The patterns of the three kinds, and the one that splits text before merging.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KINDS = ("assign", "access", "hex", "dense")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Runs of hexadecimal digits long enough to matter, so that short ones cost nothing.
LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}"
    r"|[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"
    r"|[-+=_/]*[0-9]+(?:[-+=_/]+[0-9]+)*[-+=_/]*)\Z"
)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Characters to a token below which a run is dense.
RATIO = 2.1


@dataclass(frozen=True)
class Vocabulary:
    """The ranks of a tiktoken vocabulary as the text of its file; its size is fixed."""

    ranks: bytes

    @staticmethod
    def load(path: str = VOCABULARY) -> "Vocabulary":
        with open(path, "rb") as file:
            return Vocabulary(file.read())

    def encoder(self):
        ranks = {
            base64.b64decode(word): int(rank)
            for word, rank in (line.split() for line in self.ranks.splitlines() if line)
        }
        held = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return held.encode_ordinary


def is_identifier(run: str) -> bool:
    """Whether a run is put together from words: long parts of one case, and few of them."""
    parts = WORDS.findall(run)
    letters = [p for p in parts if p[0].isalpha()]
    whole = sum(map(len, letters))
    return bool(letters) and whole >= 4 * len(parts) and 2 * whole >= len(run)


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed kinds, in order of start and kind."""
    found = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                found.append((m.start(), 1, m.end()))
    for m in LONG_HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    return sorted(found)


def dense_spans(text: str, base: list[tuple[int, int, int]], encode, ratio: float):
    """(start, kind, end, characters to a token) of runs the vocabulary finds hard to spell.

    Runs that meet a span of ``base`` are left out. Both come in order, so each span is looked at once.
    """
    seen = reach = 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while seen < len(base) and base[seen][0] < b:
            reach = max(reach, base[seen][2])
            seen += 1
        if a < reach:
            continue
        run = m.group()
        if KNOWN.match(run) or is_identifier(run):
            continue
        measured = len(run) / len(encode(run))
        if measured < ratio:
            yield a, 3, b, measured


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secrets(
    docs: DataFrame,
    vocabulary: Vocabulary | None = None,
    ratio: float = RATIO,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, counts of each kind, base_spans and spans of every document."""
    vocabulary = vocabulary or Vocabulary.load()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary's size is fixed
    schema = (
        "n_assign bigint, n_access bigint, n_hex bigint, n_dense bigint, base_sha256 string, "
        "base_spans string, spans string"
    )

    @F.pandas_udf(schema)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = shared.value.encoder()
        for texts in batches:
            rows = []
            for t in texts:
                base = fixed_spans(t) if t else []
                more = [x[:3] for x in dense_spans(t, base, encode, ratio)] if t else []
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                held = _joined(base)
                digest = hashlib.sha256(held.encode()).hexdigest()
                rows.append((*counts, len(more), digest, held, _joined(sorted(base + more))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    found = table(docs, doc_id=doc_id, text=text).select("doc_id", scan("text").alias("found"))
    return found.select("doc_id", "found.*")
