"""The package without the operators for training data, and from another working directory."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import __spark_entry__ as e
assert "topk" in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries()), sorted(e.queries())
assert "pipeline" not in e.queries()
"""

WORKER = """
import sys
sys.path.insert(0, {root!r})
from factlake.session import build_session, tune
spark = tune(build_session("probe", "local[1]", **{{"spark.ui.enabled": "false"}}))

def found(batches):
    import factlake
    yield from batches

assert spark.range(3).mapInArrow(found, "id long").count() == 3
spark.stop()
"""


def run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def copy(folder, *left_out):
    def skip(at, names):
        return [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(at, n), ROOT) in left_out]

    return shutil.copytree(ROOT, f"{folder}/copy", ignore=skip)


def test_without_llm_folders(folder):
    run(PROBE, copy(folder, "factlake/llm", "tests/llm"))


def test_without_pipeline_too(folder):
    run(PROBE, copy(folder, "factlake/llm", "tests/llm", "corpus_pipeline.py"))


def test_workers_find_the_package(folder):
    run(WORKER.format(root=ROOT), folder)
