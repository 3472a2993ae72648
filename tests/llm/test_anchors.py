"""Selection and extension of line anchors; runs that are hard to spell, against loops."""

import random
import re
import time

import brute
import texts

from slotwise.llm import lines, secret_scan
from slotwise.llm.frames import keyed_text

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_each_window_selects_one_line_and_few_lines_are_selected(spark):
    rows = [(1, "\n".join(f"line {n}" for n in range(400))), (2, "same\n" * 50), (3, "a\nb"), (4, None)]
    found = lines.anchors(keyed_text(texts.frame(spark, rows)), 3).collect()
    starts = {1: [], 2: []}
    for r in found:
        assert r.wide[r.before] == r.mark and len(r.wide) == len(r.narrow) <= 5
        starts[r.id] += [r.place - code % 3 for code in r.chosen]
    assert sorted(starts[1]) == list(range(398)) and sorted(starts[2]) == list(range(48))
    picked = [r for r in found if r.id == 1]
    assert 130 <= len(picked) <= 260  # two of four on average, never every window


def test_a_shared_anchor_is_extended_before_anything_goes(spark):
    rng = random.Random(2)
    rows = []
    for n in range(60):
        around = [rng.choice(["u", "v"]), "anchor", rng.choice(["w", "x"]), rng.choice(["y", "z", "q"])]
        rows.append((n, "\n".join([f"own {n}", *around, f"end {n}"])))
    docs = texts.frame(spark, rows)
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs).collect()}
    assert got == brute.without_lines(dict(rows))
    marks = lines.anchors(keyed_text(docs), 3).groupBy("mark").count().where("count > 1").count()
    assert marks > 0
    alone = [(1, "a\nanchor\nb\nc"), (2, "d\nanchor\ne\nf"), (3, "d\nanchor\nb\nc"), (4, "q\nd\nanchor\ne")]
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(texts.frame(spark, alone)).collect()}
    # the first place of the mark is in 1, but the run of 4 is the one of 2
    assert got == {1: alone[0][1], 2: alone[1][1], 3: "d", 4: "q"}


def test_windows_of_other_sizes_and_frequent_lines(spark):
    rng = random.Random(3)
    rows = [(n, "\n".join(rng.choices(LETTERS[:3], k=rng.randint(0, 30)))) for n in range(80)]
    for size in (1, 2, 4):
        got = lines.drop_repeated_lines(texts.frame(spark, rows), window=size)
        assert {r.doc_id: r.text for r in got.collect()} == brute.without_lines(dict(rows), size)


def slow_dense(text, encode, ratio):
    found = []
    base = brute.secrets(text)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        if any(m.start() < end and start < m.end() for start, _, end in base):
            continue
        if secret_scan.KNOWN.match(m[0]) or secret_scan.is_identifier(m[0]):
            continue
        if len(m[0]) / len(encode(m[0])) < ratio:
            found.append((m.start(), 3, m.end()))
    return found


def test_dense_runs_against_loops():
    encode = secret_scan.Vocabulary.load().encoder()
    rng = random.Random(7)

    def piece():
        kind = rng.randrange(6)
        key = "".join(rng.choices(LETTERS + LETTERS.upper() + "0123456789", k=rng.randint(18, 40)))
        return [
            key, f"token={key}", "".join(rng.choices("0123456789abcdef", k=rng.randint(30, 66))),
            "some_ordinary_identifier_name", f"secret: {key[:9]}", f"AKIA{key.upper()}",
        ][kind]

    hit = 0
    for _ in range(300):
        text = rng.choice([" ", "  ", "\n", ":"]).join(piece() for _ in range(rng.randint(0, 12)))
        base = secret_scan.fixed_spans(text)
        got = [x[:3] for x in secret_scan.dense_spans(text, base, encode, secret_scan.RATIO)]
        assert got == slow_dense(text, encode, secret_scan.RATIO)
        hit += len(got)
    assert hit > 100


def test_many_spans_in_one_text_take_linear_time():
    encode = secret_scan.Vocabulary.load().encoder()
    key = "kX9vQz7LmN2pRt8WbY4cD6fG"
    text = f"token=abcdefgh1 {key} " * 50_000
    started = time.monotonic()
    base = secret_scan.fixed_spans(text)
    found = list(secret_scan.dense_spans(text, base, encode, secret_scan.RATIO))
    assert len(base) == len(found) == 50_000
    assert time.monotonic() - started < 20
