"""Sketches, the manifest and phrases against loops over small documents."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import brute
import pytest
import texts
from pyspark.sql import functions as F

from slotwise.llm import merkle, phrases, sketches


def shingle_set(text, size=4):
    w = brute.words((text or "").translate(brute.SMALL))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def near(rows, size=4):
    """Component of every id; an id that repeats stands for all its texts."""
    held = defaultdict(list)
    for i, t in rows:
        held[i].append(shingle_set(t, size))

    def linked(a, b):
        return any(x and y and 5 * len(x & y) >= 4 * len(x | y) for x in held[a] for y in held[b])

    return brute.components(held, linked)


def varied():
    rows = [(i, t) for i, t in texts.documents()]
    base = texts.prose(31, 150).split()
    for n in range(80):
        words = list(base)
        for k in range(n % 9):
            words[(7 * n + 11 * k) % 150] = f"own{n}x{k}"
        rows.append((100 + n, " ".join(words)))
    return rows


@pytest.mark.parametrize("crowd, block", [(64, 512), (2, 8)])
def test_sketch_groups_against_all_pairs(spark, crowd, block):
    rows = varied()
    got = sketches.sketch_groups(texts.frame(spark, rows), crowd=crowd, block=block)
    want = near(rows)
    assert {r.doc_id: (r.n_shingles, r.component) for r in got.collect()} == {
        i: (len(shingle_set(t)), want[i]) for i, t in rows
    }
    assert 2 < len({want[i] for i, _ in rows if i >= 100}) < 80


def test_sketches_of_repeated_and_missing_ids(spark):
    a, b = texts.prose(41, 60), texts.prose(42, 60)
    rows = [(7, a), (7, b), (3, b), (9, a), (9, a), (None, a), (5, texts.prose(43, 60)), (4, None)]
    got = sketches.sketch_groups(texts.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {**near([r for r in rows if r[0] is not None]), None: None}
    assert want[7] == want[9] == 3
    assert {r.doc_id: r.component for r in got} == want


def test_sketches_of_no_rows(spark):
    empty = texts.frame(spark).where("doc_id < 0")
    assert sketches.sketch_groups(empty).collect() == []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encode(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(digests):
    """The root of some digests, and for each the siblings (before, after) on its way up."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for n, k in enumerate(at):
            run = k // 3 * 3
            paths[n].append(("".join(level[run:k]), "".join(level[k + 1 : run + 3])))
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
        at = [k // 3 for k in at]
    return level[0], paths


def manifested(rows):
    """[(id, leaf, subroot, root, proof, folded root)] of (id, text, lang, source, n)."""
    by_source = defaultdict(list)
    for i, text, lang, source, n in rows:
        values = [encode(v) for v in (i, source, lang, n, text)]
        leaf = sha("".join(values))
        spoiled = leaf
        if i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and text is not None:
            spoiled = sha("".join([*values[:-1], encode(text.replace("\n", ""))]))
        by_source[source].append((i is not None, i or 0, leaf, spoiled, i))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s]) for s in order}
    subs = {s: climb([leaf for _, _, leaf, _, _ in t]) for s, t in trees.items()}
    root, upper = climb([subs[s][0] for s in order])
    out = []
    for s, up in zip(order, upper, strict=True):
        for (_, _, leaf, spoiled, i), path in zip(trees[s], subs[s][1], strict=True):
            fold = spoiled
            for before, after in path + up:
                fold = sha(before + fold + after)
            proof = sha("".join(b + a for b, a in path + up))
            out.append((i, leaf, subs[s][0], root, proof, fold))
    return sorted(out, key=repr)


def entries(spark, rows):
    frame = spark.createDataFrame(
        [(*r, 1, "x") for r in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf int, tree string",
    )
    found = merkle.manifest(frame).select(
        "id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256),
        merkle.folded(F.col("other"), F.col("path")),
    )
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_manifest_against_loops(spark):
    rows = [(i, t, None if i % 3 else "en", [None, "", "a", "é", "z", "Z"][i % 6], i) for i, t in texts.documents()]
    rows += [(None, "no\nid", "en", "a", None), (None, None, None, None, None), rows[7], rows[7], (7, "other\n", "en", "é", 3)]
    assert entries(spark, rows) == manifested(rows)


def test_manifest_beyond_one_block(spark):
    """More leaves than a block in one source, and more sources than a block."""
    rows = [(i, f"line {i}\nend", "en", "hot", i) for i in range(800)]
    rows += [(1000 + i, "x\ny", "en", f"s{i}", i) for i in range(260)]
    assert entries(spark, rows) == manifested(rows)


def test_manifest_of_one_and_of_no_rows(spark):
    assert entries(spark, [(2, "a\nb", "en", "s", 3)]) == manifested([(2, "a\nb", "en", "s", 3)])
    assert entries(spark, [(2, "a", "en", "s", 3)][:0]) == []


def mined(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(brute.SMALL)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in good.items():
            longer = [b for q, b in good.items() if len(p) == 2 and len(q) == 3 and p in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("head", [1 << 18, 20, 1])
def test_phrases_against_loops(spark, head):
    rows = [(t, [None, "und", "en", "de"][i % 4]) for i, t in texts.documents()]
    rows += [(f"Big apple. big apple pie, the {texts.WORDS[n % 20]}: tab\there", "en") for n in range(40)]
    rows += [(" ".join(texts.WORDS[(n * k) % 13] for k in range(60)), "de") for n in range(9)]
    frame = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, rank int, phrase string")
    got = phrases.collocations(frame, least=3, top=25, head=head)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 3, 25)


def test_phrases_of_dense_tiles_and_long_texts(spark, monkeypatch):
    """Tiles so small that they fill, and stretches so short that texts are cut."""
    import numpy as np

    tiles = phrases.Tiles()
    first, second = np.repeat(np.arange(300), 300), np.tile(np.arange(300), 300)
    loose = tiles.add(np.concatenate([first, first]), np.concatenate([second, second]))
    found = dict(zip(*(x.tolist() for x in loose), strict=True))
    for cells, times in tiles.cells():
        found |= dict(zip(cells.tolist(), times.tolist(), strict=True))
    assert tiles.dense and found == {(a << 32) | b: 2 for a in range(300) for b in range(300)}
    monkeypatch.setattr(phrases, "AT_ONCE", 40)
    import pyarrow as pa

    rows = [("a b c. d e f\ng" * 9, "en"), (None, None), ("word " * 40, "en"), ("x, y", "de")]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([g for _, g in rows], pa.string()), pa.array([t for t, _ in rows], pa.string())], ["lang", "text"]
    )
    pairs = Counter()
    for langs, w in phrases.find(batch):
        said = [bytes(w.raw[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
        pairs.update((langs[int(w.lang[k])].as_py(), said[k], said[k + 1]) for k in np.flatnonzero(w.follows))
    want = Counter()
    for t, g in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", t or ""):
            w = piece.split()
            want.update((g, *p) for p in zip(w, w[1:], strict=False))
    assert pairs == want


def test_phrases_of_no_rows(spark):
    frame = texts.frame(spark)
    assert phrases.collocations(frame.where("doc_id < 0")).collect() == []
    assert phrases.collocations(frame.select(F.lit(None).cast("string").alias("text"), "lang")).collect() == []
