"""The package reaches the executors by itself, wherever the driver was started."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

RUN = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from millrace.session import local_session
spark = local_session(2)
for name in ("m4_batch_scoring", "v9_blur"):
    print("rows", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_runs_from_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    where = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    done = subprocess.run([sys.executable, "-c", RUN, str(where)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("rows ") == 2, done.stderr[-2000:]


def test_imports_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shown = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", shown], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("[]") and int(done.stdout.split()[0]) > 140, done.stderr[-2000:]


def test_imports_where_a_library_of_the_optional_subpackage_is_missing(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shown = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    done = subprocess.run([sys.executable, "-c", shown], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("[]") and int(done.stdout.split()[0]) > 140, done.stderr[-2000:]
