"""The entry without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["paperloom/llm", "corpus_pipeline.py"], ["paperloom/llm"]])
def test_imports_without_the_training_data_package(tmp_path, gone):
    for name in ("paperloom", "__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=lambda folder, names: [n for n in names if n == "__pycache__" or f"{Path(folder).name}/{n}" in gone])
        elif source.exists() and name not in gone:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e, bench; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), any(n.startswith('op1') for n in q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)
    assert said.returncode == 0, said.stderr
    n, known, operators, pipeline = said.stdout.split()
    assert int(n) > 60 and (known, operators, pipeline) == ("True", "False", "False")


def test_other_import_errors_surface(tmp_path):
    shutil.copytree(ROOT / "paperloom", tmp_path / "paperloom", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "paperloom/llm").mkdir()
    (tmp_path / "paperloom/llm/__init__.py").write_text("")
    (tmp_path / "paperloom/llm/queries.py").write_text("import not_installed_here\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode != 0 and "not_installed_here" in said.stderr
