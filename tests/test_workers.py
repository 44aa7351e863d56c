"""Python workers must not need this package on their path."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from workload.session import local_session
from pyspark.sql import functions as F
from spanloom.functions.text import clean_value
from spanloom.operators.converters import assign_occurrences
spark = local_session("workers", "2")
rows = spark.createDataFrame([(0, "é ali", ["ali"])], "ord bigint, text string, surfaces array<string>")
print(assign_occurrences(rows).select("starts", clean_value(F.col("text"))).first())
"""


def test_functions_travel_by_value(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=120
    )
    assert "starts=[2]" in done.stdout, done.stderr[-2000:]
