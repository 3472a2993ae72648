"""The registered queries over the smallest tables: SQL where there is some, loops elsewhere."""

import re
import subprocess
from pathlib import Path

import brute
import compare
import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from slotwise.llm import language, oracle, queries
from slotwise.llm.frames import read

SMALL = "/root/testdata/sf0.001"
ROOT = Path(driver.__file__).parent


@pytest.fixture(scope="module")
def con():
    return compare.duck(SMALL)


@pytest.fixture(scope="module")
def documents(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.difference(queries.QUERIES[name](spark, SMALL), con, oracle.SQL[name]) is None


def rows(spark, name, *columns):
    found = queries.QUERIES[name](spark, SMALL).select("doc_id", *columns)
    return {r[0]: tuple(r[1:]) for r in found.collect()}


def test_languages(spark, con):
    got = rows(spark, "op1_compression_language", "held_out", "lang_pred", "score")
    labels = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [i for i in got if got[i][0]]
    assert len(held) > 20
    assert sum(got[i][1] == labels[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= g[2] <= 1 and g[1] in {*labels.values(), "und"} for g in got.values())


def test_secrets(spark, documents):
    got = rows(spark, "op3_token_efficiency_secrets", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for i, text in documents.items():
        base = brute.secrets(text)
        said = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base]
        assert got[i][:4] == (
            *(sum(k == kind for _, k, _ in base) for kind in range(3)), brute.sha(",".join(said)),
        )
        assert set(said) <= {*got[i][4].split(",")}


def test_quality_counts(spark, documents):
    got = rows(
        spark, "op4_covariance_outliers",
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )
    for i, text in documents.items():
        counts = brute.statistics(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert got[i][:6] == (*counts, failed)
        assert not (failed and got[i][6])


def test_near_copies(spark, documents):
    got = rows(spark, "op5_vantage_near_copies", "fingerprint", "component_id")
    fps, component = brute.near_copies(documents)
    assert got == {i: (f"{fps[i]:016x}", component[i]) for i in documents}


def test_byte_repeats(spark, documents):
    got = rows(spark, "op7_column_suffixes", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    units = {i: (t or "").encode() for i, t in documents.items()}
    for i, gone in brute.repeated(units, 200).items():
        kept = bytes(x for x, g in zip(units[i], gone, strict=True) if not g)
        assert got[i] == (len(gone), sum(gone), brute.runs(gone), brute.sha(kept))


def test_word_repeats(spark, documents):
    got = rows(spark, "op8_word_index", "n_words", "n_removed", "kept_sha256")
    units = {i: brute.words(t) for i, t in documents.items()}
    for i, gone in brute.repeated(units, 35).items():
        kept = " ".join(x for x, g in zip(units[i], gone, strict=True) if not g)
        assert got[i] == (len(gone), sum(gone), brute.sha(kept))


def test_pipeline_against_loops(spark, con, documents):
    """Stage by stage over what the one before kept."""
    encoders = language.Encoders(language.learn(read(spark, SMALL, "documents")))
    kept = {i: t for i, t in documents.items() if not encoders.decide(t, language.MARGIN)[2]}
    assert 0.95 * len(documents) < len(kept)
    kept = brute.without_lines(kept, passage=50)
    component = brute.similar(kept)
    kept = {i: t for i, t in kept.items() if component[i] == i}
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    hit = brute.contamination(kept, items)
    kept = {i: t for i, t in kept.items() if not hit[i][3]}
    mix = duckdb.connect()
    mix.execute("CREATE TABLE kept(doc_id BIGINT, text VARCHAR)")
    mix.executemany("INSERT INTO kept VALUES (?, ?)", list(kept.items()))
    mix.execute(
        f"""CREATE VIEW documents AS SELECT doc_id, k.text, source, lang FROM kept k
            JOIN (SELECT doc_id, source, lang FROM '{SMALL}/documents.parquet') USING (doc_id)"""
    )
    expected = mix.execute(
        f"SELECT doc_id, probability, weight FROM ({oracle.raking_sql()}) WHERE sampled"
    ).fetchall()
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.probability, r.weight) for r in got.collect()) == sorted(expected)
    assert {r.doc_id: r.text for r in got.collect()} == {i: kept[i] for i, *_ in expected}
    assert got.columns[:5] == read(spark, SMALL, "documents").columns


def test_each_stage_gives_documents(spark):
    docs = read(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "lines", "near-copies", "benchmark", "mix",
    ]


def test_one_query_for_each_operator():
    names = [n for n in driver.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert driver.queries()["pipeline"] is corpus_pipeline.run
    assert oracle.SQL.items() <= driver.oracle_sql().items()


def test_nothing_else_imports_the_subpackage():
    said = subprocess.run(
        ["grep", "-rlE", r"slotwise\.llm|corpus_pipeline", "--include=*.py", str(ROOT)],
        capture_output=True, text=True, check=False,
    ).stdout.split()
    outside = {Path(p).relative_to(ROOT) for p in said}
    allowed = {Path("__spark_entry__.py"), Path("corpus_pipeline.py"), Path("tests/test_entry.py")}
    assert {p for p in outside if "llm" not in p.parts} <= allowed


def test_native_operators_run_no_python(spark):
    """Plans of the operators that use DataFrame functions only."""
    for name in ("op4_covariance_outliers", "op6_raked_mix", "op10_winnowed_lines"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
