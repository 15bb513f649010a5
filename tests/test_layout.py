"""The package without its optional part, and rules of the repository."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def copy(tmp_path):
    for name in ("spindrift", "__spark_entry__.py", "corpus_pipeline.py"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, target)
    return tmp_path


def names(folder):
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return set(out.stdout.split())


def test_works_without_the_corpus_operators(tmp_path):
    from spindrift import catalog

    folder = copy(tmp_path)
    shutil.rmtree(folder / "spindrift" / "llm", ignore_errors=True)
    assert names(folder) == set(catalog.queries())
    if (folder / "corpus_pipeline.py").exists():
        (folder / "corpus_pipeline.py").unlink()
        assert names(folder) == set(catalog.queries())


def test_other_import_errors_are_not_swallowed(tmp_path):
    folder = copy(tmp_path)
    if not (folder / "corpus_pipeline.py").exists():
        return
    (folder / "corpus_pipeline.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert out.returncode != 0 and "no_such_module" in out.stderr


def test_nothing_else_imports_the_corpus_operators():
    for folder, dirs, files in os.walk(os.path.join(ROOT, "spindrift")):
        if os.path.basename(folder) == "llm":
            dirs.clear()
            continue
        for f in files:
            if f.endswith(".py"):
                assert "spindrift.llm" not in open(os.path.join(folder, f)).read(), f


def test_no_local_checkpoints():
    word = "local" + "Checkpoint"
    for folder, dirs, files in os.walk(ROOT):
        dirs[:] = [d for d in dirs if d != ".git"]
        for f in files:
            if f.endswith(".py"):
                assert word not in open(os.path.join(folder, f)).read(), f
