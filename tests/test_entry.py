"""The entry works with and without the text operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
WITHOUT = """
import sys
sys.path.insert(0, {root!r})

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.startswith({gone!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names = entry.queries()
print(len(names), any(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names)
assert entry.oracle_sql().keys() <= names.keys()
"""


def said(gone):
    done = subprocess.run(
        [sys.executable, "-c", WITHOUT.format(root=ROOT, gone=gone)],
        capture_output=True, text=True, check=False,
    )
    return done.returncode, done.stdout.split()


def test_other_queries_stay_without_the_text_operators():
    for gone in (("slotwise.llm",), ("corpus_pipeline",)):
        code, (count, numbered, pipeline) = said(gone[0])
        assert code == 0
        assert int(count) > 60
        assert (numbered, pipeline) == ("False", "False")


@pytest.mark.skipif(not Path(ROOT, "slotwise", "llm").exists(), reason="not installed")
def test_a_broken_import_is_not_hidden():
    assert said("zstandard")[0] != 0
