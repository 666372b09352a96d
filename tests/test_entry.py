import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

TOP = Path(entry.__file__).parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "macd" in df.columns


def test_works_without_the_corpus_operators(tmp_path):
    """The folders may be deleted."""
    for f in [TOP / "__spark_entry__.py", *(TOP / "barloom").rglob("*.py")]:
        if "llm" not in f.relative_to(TOP).parts:
            (to := tmp_path / f.relative_to(TOP)).parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
