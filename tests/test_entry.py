"""The entry points work with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("missing", [["corpus_pipeline"], ["crawlatlas.llm"], ["corpus_pipeline", "crawlatlas.llm"],
                                     ["public_tokenizers"]])
def test_entry_points_without_the_subpackage(missing):
    code = f"import sys; [sys.modules.__setitem__(m, None) for m in {missing!r}]; import __spark_entry__ as e; " \
           "from crawlatlas.registry import QUERIES; assert set(e.queries()) == set(QUERIES) == set(e.oracle_sql()); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr


def test_errors_inside_the_subpackage_are_not_hidden():
    code = "import sys, types; m = types.ModuleType('corpus_pipeline'); sys.modules['tiktoken'] = None; " \
           "sys.modules['tokenizers'] = None; sys.modules['pyarrow'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    if Path(ROOT, "crawlatlas", "llm", "queries.py").exists():
        assert done.returncode != 0 and "import of" in done.stderr
