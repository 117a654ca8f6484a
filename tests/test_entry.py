"""The driver's contract, with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).parent.parent


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["l_returnflag", "tally"]


@pytest.mark.parametrize("gone", [["weftline/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], ["weftline/llm"]])
def test_the_rest_imports_without_the_optional_parts(tmp_path, gone):
    for name in ("weftline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = REPO / name
        for f in [source] if source.is_file() else source.rglob("*.py"):
            relative = f.relative_to(REPO)
            if f.exists() and not any(relative.is_relative_to(g) for g in gone):
                (tmp_path / relative).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / relative).write_text(f.read_text())
    left = "weftline/llm" not in gone and (REPO / "weftline/llm").exists()
    code = f"import __spark_entry__ as e; q = e.queries(); assert 'phi' in q and any(x.startswith('op') for x in q) == {left} and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
