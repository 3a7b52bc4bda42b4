"""The entry point with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
print(len(names), any(n.startswith("op1_") for n in names), "pipeline" in names)
"""


@pytest.mark.parametrize("hidden", [["gridspark.llm"], ["gridspark.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_starts_with_parts_missing(hidden):
    run = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    n, operators, pipeline = run.stdout.split()
    # without hiding the subpackage its operators show only where it is there at all
    there = (ROOT / "gridspark" / "llm").is_dir() and "gridspark.llm" not in hidden
    assert int(n) > 150 and operators == str(there) and pipeline == "False"


def test_an_error_inside_the_subpackage_shows():
    broken = HIDE.format(hidden=["pyarrow.fs"])
    run = subprocess.run([sys.executable, "-c", broken], cwd=ROOT, capture_output=True, text=True)
    assert (run.returncode != 0) == (ROOT / "gridspark" / "llm").is_dir()
