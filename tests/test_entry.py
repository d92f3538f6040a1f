"""The registered queries, with and without what the corpus operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; from rowloom import catalog; assert set(catalog.QUERIES) <= set(e.queries()); assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()) - len(catalog.QUERIES))"


def registered(before: str = "") -> int:
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", before + COUNT], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    return int(run.stdout)


def test_all_queries_are_registered():
    there = (ROOT / "rowloom" / "llm").exists() and (ROOT / "corpus_pipeline.py").exists()
    assert registered() == (11 if there else 0)


def test_a_missing_library_leaves_the_engine():
    gone = "import sys; sys.modules['xxhash'] = None\n"
    assert registered(gone) == 0
