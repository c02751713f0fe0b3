"""The entry file, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(n.startswith('op1_') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("left_out", [[], ["talkmill/llm"], ["corpus_pipeline.py"], ["talkmill/llm", "corpus_pipeline.py"]])
def test_entry_loads_from_what_is_there(tmp_path, left_out):
    def skipped(folder, names):
        there = Path(folder).relative_to(ROOT)
        return [n for n in names if n in (".git", "__pycache__", "tests") or str(there / n) in left_out]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=skipped)
    found = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    number, operators, pipeline = found.stdout.split()[-3:]
    assert int(number) >= 86
    if left_out:
        assert (operators == "True") == ("talkmill/llm" not in left_out and (ROOT / "talkmill/llm").exists())
        assert pipeline == "False"
