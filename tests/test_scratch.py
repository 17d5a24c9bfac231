"""Intermediate tables: where they lie, and who drops them."""

import os
import subprocess
import sys
import threading
from pathlib import Path

from corpusmill.scratch import Table, dropped_after, written

PLAIN = """
from corpusmill.session import local_session
from corpusmill.scratch import scratch_dir, written
from corpusmill.plans import catalogue
spark = local_session("plain", cores=2, memory="1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert written(spark.range(3)).count() == 3 and scratch_dir(spark) == scratch_dir(spark)
assert catalogue.QUERIES["token_budget_cut"](spark, "/root/testdata/sf0.001").count() > 0
print("well")
"""


def test_a_session_without_checkpoint_folder(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parents[1])}
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "well", done.stderr[-2000:]


def exists(table):
    return os.path.exists(table.path.removeprefix("file:"))


def test_blocks_drop_what_their_own_thread_wrote(spark):
    made = {}

    def elsewhere():
        made["other"] = Table(spark.range(2))

    with dropped_after(spark) as outer:
        made["outer"] = Table(spark.range(2))
        with dropped_after(spark) as kept:
            made["inner"], made["kept"] = Table(spark.range(2)), Table(spark.range(2))
            kept.add(made["kept"].path)
            thread = threading.Thread(target=elsewhere)
            thread.start()
            thread.join()
        assert [exists(made[x]) for x in ("inner", "kept", "outer", "other")] == [False, True, True, True]
        outer.add(made["outer"].path)
    assert [exists(made[x]) for x in ("kept", "outer", "other")] == [False, True, True]
    assert written(spark.range(4)).count() == 4
