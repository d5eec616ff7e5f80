"""Executors that cannot import the package still run its functions."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as driver
from modelyard.session import local_session
spark = local_session(cpus=2)
for name in ("score_rows", "training_step", "lifecycle_fold", "progress_stream"):
    assert driver.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
