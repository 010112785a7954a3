"""The entry module without the numbered operators."""
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
_SAYS = "import __spark_entry__ as e; from sheafline.plans import catalog as c; print(len(e.queries()) - len(c.QUERIES), 'pipeline' in e.queries(), len(e.oracle_sql()) - len(c.ORACLES))"


def copied(tmp_path, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.pyc", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda d, names: [*skip(d, names), *[n for n in names if str((Path(d) / n).relative_to(ROOT)) in without]])
    return tmp_path / "repo"


def said(folder):
    return subprocess.run([sys.executable, "-c", _SAYS], cwd=folder, capture_output=True, text=True)


@pytest.mark.parametrize("without", [("sheafline/llm", "tests/llm"), ("sheafline/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_imports_without_them(tmp_path, without):
    out = said(copied(tmp_path, *without))
    assert out.stdout.split() == ["0", "False", "0"], out.stderr


def test_a_left_over_folder_is_no_module(tmp_path):
    folder = copied(tmp_path, "sheafline/llm", "tests/llm")
    (folder / "sheafline/llm/__pycache__").mkdir(parents=True)
    assert said(folder).stdout.split() == ["0", "False", "0"]


def test_a_fault_inside_is_not_hidden(tmp_path):
    folder = copied(tmp_path, "sheafline/llm", "tests/llm")
    (folder / "sheafline/llm").mkdir()
    (folder / "sheafline/llm/__init__.py").write_text("")
    (folder / "sheafline/llm/registry.py").write_text("import no_such_module\n")
    out = said(folder)
    assert out.returncode and "no_such_module" in out.stderr
