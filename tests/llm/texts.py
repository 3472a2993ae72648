"""Small made-up documents with the awkward cases every operator must handle."""

import random

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnoé", k=2 + i % 7)) for i in range(300)]


def prose(seed, count, per_line=9):
    rng = random.Random(seed)
    found = [rng.choice(WORDS) for _ in range(count)]
    return "\n".join(" ".join(found[k : k + per_line]) for k in range(0, count, per_line))


def documents():
    """(doc_id, text): nulls, empty, very short, copies, near copies, shared passages, one long."""
    shared, again = prose(1, 60), prose(2, 45)
    texts = [
        None, "", " \n\t ", "one", "Two words", "?!", prose(3, 120), prose(3, 120),
        prose(3, 120).replace(WORDS[5], "changed"), shared, f"{prose(4, 30)}\n{shared}\n{prose(5, 30)}",
        f"{prose(6, 200)}\n{again}", f"{again}\n{prose(7, 10)}", f"{again}\n{again}", "same " * 300,
        "AbC é " * 50, prose(8, 6000), "a\nb\nc\na\nb\nc\nd", "A\x0bB\x0cC\rD", None, "",
        *[f"{prose(9, 80)}\n{prose(100 + n, 12)}" for n in range(6)],
    ]
    return list(enumerate(texts))


def frame(spark, rows=None, clash=True):
    """The documents as a table, with further columns named like those an operator uses inside."""
    rows = documents() if rows is None else rows
    extra = [(i, t, "x", "s", 1, "id", "mark", None) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, mark string, fp string"
    found = spark.createDataFrame(extra, schema)
    return found if clash else found.select("doc_id", "text")
