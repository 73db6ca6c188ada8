"""The driver's contract, with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_optional_parts(tmp_path):
    """In a copy without them, and where a library that they need is missing."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    test = "import __spark_entry__ as e; q = e.queries(); assert 'district_stats' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for folder, code in ((copy, test), (ROOT, "import sys; sys.modules['public_tokenizers'] = None; " + test)):
        subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, check=True, timeout=120)
