"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os
from pathlib import Path

import duckdb
import pytest

from hopframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, tmp_path, name):
    catalog.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    if name not in catalog.oracle_sql():
        assert duck.execute("SELECT count(*) FROM got").fetchone()[0] > 0
        return
    duck.execute(f"CREATE OR REPLACE TABLE want AS {catalog.oracle_sql()[name]}")
    schema = [sorted((r[0], r[1]) for r in duck.execute(f"DESCRIBE {t}").fetchall()) for t in ("got", "want")]
    assert schema[0] == schema[1]
    columns = ", ".join(f'"{c}"' for c, _ in schema[0])
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []


def test_entry_module_imports_without_the_subpackage():
    """Only the entry module knows of the subpackage, and it does without."""
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['hopframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'frame_rms' in e.queries() and e.oracle_sql(); print(len(e.queries()))"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    broken = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert broken.returncode == 0 if not (root / "hopframe/llm").exists() else "xxhash" in broken.stderr
    for path in root.glob("hopframe/**/*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
