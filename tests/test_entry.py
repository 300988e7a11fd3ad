"""The entry without the text operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PRINTED = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), 'match_c' in e.oracle_sql())"


def _copy(folder, *left_out):
    shutil.copytree(os.path.join(REPO, "linkspan"), folder / "linkspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out:
            shutil.copy(os.path.join(REPO, name), folder / name)


def _printed(folder):
    done = subprocess.run([sys.executable, "-c", PRINTED], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_without_the_text_folders(tmp_path):
    _copy(tmp_path)
    number, pipeline, core = _printed(tmp_path)
    assert int(number) > 80 and pipeline == "False" and core == "True"


def test_without_the_pipeline_too(tmp_path):
    _copy(tmp_path, "corpus_pipeline.py")
    assert _printed(tmp_path)[1:] == ["False", "True"]
