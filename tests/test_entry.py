import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_library_does_without_the_llm_part():
    code = "import sys; sys.modules['pagemill.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and not [q for q in e.queries() if q.startswith(('p2', 'p3', 'p5', 'p6', 'p7', 'p8'))]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    used = [p for p in (ROOT / "pagemill").rglob("*.py") if "llm" not in p.parts and "pagemill.llm" in p.read_text()]
    assert used == []
