import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_name_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "p3_found" in entry.queries()


def test_core_does_not_import_the_subpackage():
    code = "import sys; sys.modules['tidescan.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
