import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_the_rest_of_the_tests_is_found_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0 and "error" not in found.stdout.lower().split("collected")[-1], found.stdout[-2000:]


def test_a_broken_import_inside_the_subpackage_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "quillon/llm").mkdir()
    (tmp_path / "quillon/llm/__init__.py").write_text("")
    (tmp_path / "quillon/llm/queries.py").write_text("import there_is_no_such_module\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, timeout=120).returncode != 0


def test_nothing_else_imports_the_subpackage():
    for p in [*ROOT.glob("quillon/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quillon.llm" not in p.read_text(), p
