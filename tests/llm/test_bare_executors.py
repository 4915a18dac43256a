"""All queries of the subpackage with workers that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

from conftest import DATA

ROOT = Path(__file__).resolve().parent.parent.parent
PROBE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})  # the driver's own path; workers do not see it
from variegate.session import get_session
import __spark_entry__ as entry
spark = get_session("bare", "local[4]", shuffle_partitions=4, **{{"spark.ui.enabled": "false"}})
spark.sparkContext.setLogLevel("OFF")

def known(batches):
    try:
        import variegate
    except ImportError:
        return
    raise ValueError("the package is there")
    yield

spark.range(4).mapInArrow(known, "id long").collect()
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, {DATA!r}).write.format("noop").mode("overwrite").save()
        print("done", name, flush=True)
"""


def test_queries_run_without_the_package_on_executors(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=900)
    done = [line.split()[1] for line in run.stdout.splitlines() if line.startswith("done ")]
    assert len(done) >= 14 and run.returncode == 0, (done, run.stderr[-2000:])
