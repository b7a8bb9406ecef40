import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_parts(tmp_path):
    root = Path(entry.__file__).parent
    for f in root.glob("tessera/**/*.py"):
        if "llm" not in f.parts:
            (tmp_path / f.relative_to(root)).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / f.relative_to(root)).write_text(f.read_text())
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
