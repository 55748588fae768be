"""The entry module without what the training-data operators need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("absent", ["xxhash", "factmill.llm", "corpus_pipeline"])
def test_core_queries_are_there_without(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; names = set(e.queries()); print(len(names), any(n.startswith('op') or n == 'pipeline' for n in names))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 50 and out[1] == "False"
