import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from tests.compare import SMALL, oracle, rows

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    assert entry.entry(spark).columns == ["city", "day", "cnt"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    from geostrata import registry
    from geostrata.sources.warehouse import ORACLE

    sql = ORACLE + registry._count_sql("city day", f"{registry._in(registry.WIDE)} AND date >= DATE '2024-01-10'")
    assert rows(registry.flagship(spark, SMALL)) == oracle(sql, SMALL)


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "geostrata", tmp_path / "geostrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, has = said.stdout.split()
    assert int(n) > 90 and has == "False"
