import re
import shutil
import subprocess
import sys
from pathlib import Path

from helpers import same_rows

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_is_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "heddle", tmp_path / "heddle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_only_the_absence_of_all_corpus_operators_is_passed_over(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "heddle", tmp_path / "heddle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    own = tmp_path / "heddle/llm"
    own.mkdir()
    (own / "__init__.py").touch()
    (own / "queries.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "heddle").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text())


def test_shell(spark, capsys):
    from heddle.__main__ import run
    from heddle.engine import Engine

    run(Engine(spark), "CREATE TABLE t (a INT); INSERT INTO t VALUES (41); SELECT a + 1 AS b FROM t; SELECT nope FROM t; DROP TABLE x")
    out = capsys.readouterr().out
    assert "42" in out and "UNRESOLVED_COLUMN" in out and "error 42P01" in out


def test_flagship_is_the_same_as_sql(spark, sf, duck):
    same_rows(__spark_entry__.queries()["flagship"](spark, sf), duck.sql(__spark_entry__.oracle_sql()["flagship"]))
