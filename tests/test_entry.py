import subprocess
import sys
from pathlib import Path


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 140 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_smoke_query(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6000
