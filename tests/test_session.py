"""What a session sends to its workers."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

JOB = """
import sys
sys.path.insert(0, {repo!r})
from cellweave.session import local_session
from cellweave.operators.userfn import table_function
from cellweave.operators.sections import suffix_sections
from cellweave.tables import Layout
spark = local_session("1", shuffle_partitions=1)
df = spark.createDataFrame([("t", 0, 0, ["a"])], "table_id string, part_ix int, row_ix bigint, cells array<string>")
print("rows", table_function(df, lambda parts: parts[0])[0].first().cells)
lines = spark.createDataFrame([("t", 0, "One PART"), ("t", 1, "text")], "table_id string, row_ix bigint, line string")
print("section", suffix_sections(lines, " PART", "List:", Layout(False)).first().name)
"""


def test_workers_need_no_installed_package(tmp_path):
    """The driver alone knows where the package is; tasks import what was sent to them."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB.format(repo=str(REPO))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows ['a']" in done.stdout and "section One" in done.stdout, done.stderr[-2000:]
