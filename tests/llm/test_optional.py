"""What is not installed takes away its own queries only."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize(("absent", "left"), [("public_tokenizers", True), ("ahocorasick", False)])
def test_queries_without_a_package(absent, left):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print('scan_predicate' in q, set(o) <= set(q), 'op3_line_dedup' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True", str(left)], out.stderr
