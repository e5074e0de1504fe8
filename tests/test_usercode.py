"""The time limit of user code covers its Spark jobs."""

import time

import pytest

from tidemill.errors import InputError
from tidemill.plans import usercode

SLEEPS = """
from pyspark.sql import functions as F
@F.udf("long")
def slow(x):
    import time
    time.sleep(60)
    return x
df = df.withColumn("id", slow("id"))
"""


def running(spark):
    return spark.sparkContext.statusTracker().getActiveStageIds()


def ended(spark, seconds=15):
    until = time.time() + seconds
    while running(spark) and time.time() < until:
        time.sleep(0.2)
    return not running(spark)


@pytest.mark.parametrize("code", [SLEEPS, SLEEPS + "\ndf.count()"])
def test_a_sleeping_udf_is_stopped(spark, code):
    began = time.time()
    with pytest.raises(InputError, match="more than 2 seconds"):
        usercode.apply_code(spark.range(4), code, lambda out: out.collect(), 2)
    assert time.time() - began < 2 + usercode.PATIENCE and ended(spark)


def test_loops_of_python_are_stopped(spark):
    with pytest.raises(InputError, match="more than 0.5 seconds"):
        usercode.run_code(spark.range(3), "while True:\n    try:\n        pass\n    except Exception:\n        pass", 0.5)


def test_other_jobs_go_on(spark):
    import threading

    found = []
    other = threading.Thread(target=lambda: found.append(spark.range(200).repartition(2).rdd.map(lambda r: time.sleep(0.02) or r[0]).sum()))
    other.start()
    with pytest.raises(InputError, match="more than"):
        usercode.preview(spark.range(4), SLEEPS, 1)
    other.join()
    assert found == [19900]


def test_what_is_done_in_time(spark):
    assert usercode.preview(spark.range(50), "df = df.where('id > 10')").count() == 20
    assert usercode.apply_code(spark.range(5), "df = df.where('id > 2')", lambda out: out.count()) == 2
    with pytest.raises(InputError, match="no row"):
        usercode.apply_code(spark.range(5), "df = df.where('id > 7')", lambda out: out.count())
    with pytest.raises(InputError, match="ZeroDivisionError"):
        usercode.run_code(spark.range(5), "1 / 0")
    batches = "def pandas_batch(frame):\n    frame['id'] += len(frame) > 0\n    return frame"
    assert usercode.apply_code(spark.range(3), batches, lambda out: sorted(r[0] for r in out.collect())) == [1, 2, 3]
