"""Executors that have no path to this package run the queries all the same: a process whose folder is empty, and whose driver alone knows the repository."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
NAMES = ["quality_gate", "url_normalize", "suppressed_deliveries", "clean_feed_text", "stream_deliveries"]
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from millrace import session

spark = session.build("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("OFF")
print("entry", __spark_entry__.entry(spark).count())
for name in sys.argv[3:]:
    print(name, len(__spark_entry__.queries()[name](spark, sys.argv[2]).collect()))
"""


def run(folder: Path, sf: str, *names: str) -> dict[str, int]:
    """Rows of the flagship query and of these, run by a process of its own."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN, str(ROOT), sf, *names], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return {k: int(n) for k, n in (line.split() for line in done.stdout.splitlines()[-len(names) - 1 :])}


def test_executors_without_a_path_to_the_package(tmp_path, sf):
    assert all(run(tmp_path, sf, *NAMES).values())
