"""The entry module without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("without", [("figureyard/llm",), ("figureyard/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without(tmp_path, without):
    if not (ROOT / "figureyard/llm").is_dir() or not (ROOT / "corpus_pipeline.py").exists():
        pytest.skip("the optional parts are not there")
    left_out = {str(ROOT / name) for name in without}

    def ignored(folder: str, names: list[str]) -> list[str]:
        return [n for n in names if f"{folder}/{n}" in left_out or n == "__pycache__"]

    shutil.copytree(ROOT / "figureyard", tmp_path / "figureyard", ignore=ignored)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without:
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), e.__file__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and str(tmp_path) in out[2]
    assert out[1] == str(not without)


def test_a_pipeline_on_another_path_is_not_taken(tmp_path, monkeypatch):
    if not (ROOT / "figureyard/llm").is_dir() or not (ROOT / "corpus_pipeline.py").exists():
        pytest.skip("the optional parts are not there")
    monkeypatch.setenv("PYTHONPATH", str(ROOT))
    test_entry_imports_without(tmp_path, ("corpus_pipeline.py",))
