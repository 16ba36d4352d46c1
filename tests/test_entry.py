"""The driver contract stands without the optional part, whatever is left of it."""

import os
import subprocess
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "a broken module"])
def test_queries_without_the_optional_part(left):
    top = tempfile.mkdtemp(prefix="briefloom-entry-")
    with open(os.path.join(ROOT, "__spark_entry__.py")) as f, open(os.path.join(top, "__spark_entry__.py"), "w") as g:
        g.write(f.read())
    os.makedirs(os.path.join(top, "briefloom"))
    for name in os.listdir(os.path.join(ROOT, "briefloom")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "briefloom", name), os.path.join(top, "briefloom", name))
    if left != "nothing":
        os.makedirs(os.path.join(top, "briefloom", "llm"))
    if left == "a broken module":
        with open(os.path.join(top, "corpus_pipeline.py"), "w") as f:
            f.write("import a_package_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=top, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": top, "PYTHONDONTWRITEBYTECODE": "1"})
    assert out.returncode == 0, out.stderr
    n, optional, twins = out.stdout.split()
    assert int(n) >= 50 and optional == "0" and twins == "True"
