import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sahifa import runtime


def test_cut_and_clear(spark):
    df = runtime.cut(spark.range(10).withColumn("part", F.spark_partition_id()))
    assert df.count() == 10
    folder = runtime.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    assert any(x.startswith("sahifa-") for x in os.listdir(folder))
    assert runtime.clear_scratch(spark) >= 1
    assert runtime.clear_scratch(spark) == 0


def test_discard(spark):
    df = runtime.cut(spark.range(5))
    path = df._sahifa_path.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path)
    runtime.discard(df)
    assert not os.path.exists(path)


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        runtime.shared_dir(SimpleNamespace(sparkContext=context, conf={}))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_broadcast_only_below_the_bound(spark):
    small = spark.range(10).withColumn("t", F.lit("xx"))
    big = spark.range(100)
    assert "ResolvedHint" in plan(runtime.broadcast_if_small(small, 10)) or "broadcast" in plan(runtime.broadcast_if_small(small, 10))
    assert "broadcast" not in plan(runtime.broadcast_if_small(big, 10)).lower()
    assert "broadcast" not in plan(runtime.broadcast_if_small(small, 10, F.length("t"), 19)).lower()
    assert "broadcast" in plan(runtime.broadcast_if_small(small, 10, F.length("t"), 20)).lower()
    assert "broadcast" in plan(runtime.broadcast_if_small(small.limit(0), 10)).lower()
