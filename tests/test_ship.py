import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from tidemark.session import get_spark
rows = __spark_entry__.queries()["rate_limited"](get_spark(cpus=2), sys.argv[2]).count()
print("rows", rows)
"""


def test_executors_find_the_package_from_any_folder(sf_dir, tmp_path):
    """A driver that has the package on its own path only."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", CODE, repo, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1000" in out.stdout, out.stderr[-2000:]
