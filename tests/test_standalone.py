"""The library without its optional text part, and without a package that part needs."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e, warnings; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op1_') for n in q), 'operating_point' in q)"


def run(code, folder):
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def test_imports_and_queries_without_the_text_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json"))
    assert not (copy / "boxlens/llm").exists()
    done = run(COUNT, copy)
    n, oracles, texts, core = done.stdout.split()[-4:]
    assert int(n) > 160 and int(oracles) > 150 and (texts, core) == ("False", "True"), done.stderr
    assert run("import bench, tests.harness", copy).returncode == 0
    (copy / "boxlens/llm").mkdir()  # an empty folder left behind
    assert run(COUNT, copy).stdout.split()[-4:] == [n, oracles, "False", "True"]


@pytest.mark.skipif(not (TOP / "boxlens/llm").exists(), reason="without the text part")
def test_queries_without_a_library_of_the_text_part():
    blocked = "import sys; sys.modules['sentencepiece'] = None; " + COUNT
    done = run(blocked, TOP)
    assert done.stdout.split()[-2:] == ["False", "True"] and "left out" in done.stderr
