"""The working folder of a session that names none: a process of its own, as a running session's settings can't change."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from lodestack.session import local_session
from lodestack.sources import scratch, tables
spark = local_session(2, "1g")
spark.sparkContext.setLogLevel("ERROR")
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = scratch.cut(spark.range(3), "a"), scratch.folder(spark, "b")
assert a.count() == 3 and a.cut_path.rpartition("/lodestack/")[0] == b.rpartition("/lodestack/")[0]
scratch.forget(a)
import os
assert not os.path.exists(a.cut_path)
from lodestack.plans import PLANS
sf = "/root/testdata/sf0.001"
for name in ("s3_read_write_chunks", "d5_near_duplicate_groups"):
    print(name, next(m.QUERIES[name] for m in PLANS if name in m.QUERIES)(spark, sf).count())
spark.stop()
"""


def test_without_checkpoint_dir(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
