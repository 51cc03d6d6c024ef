"""Sessions, tables and scratch space."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with; on a cluster the given session is used instead."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("sahifa")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers where neither PYTHONPATH nor the working folder has it."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or any(x and os.path.realpath(x) == str(root) for x in known):
        return
    _shipped.add(app)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "sahifa").rglob("*.py")):
            z.write(f, f.relative_to(root))
    target = f"{shared_dir(spark)}/sahifa-{app}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set, else a temporary one in local mode; on a cluster it must be set."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not known:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        if there.isDefined():
            return there.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = os.path.join(tempfile.gettempdir(), "sahifa-checkpoints")
        spark.sparkContext.setCheckpointDir(known)
    return known


_written: dict[str, list[str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as a table and read it back: the lineage ends there, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sahifa-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sahifa_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that cut() gave, when nothing that is still to run reads it."""
    spark = df.sparkSession
    _delete(spark, [df._sahifa_path])
    _written[spark.sparkContext.applicationId].remove(df._sahifa_path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete what cut() wrote for this application; call it when results are written, since lazy frames still read it. Returns the number of tables."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def broadcast_if_small(df: DataFrame, rows: int, weight: Column | None = None, most: int = 0) -> DataFrame:
    """df with a broadcast hint when it is counted to hold no more than `rows`, and no more than `most` of the sum of `weight` where its rows can be long; beyond that the planner joins by shuffle."""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0)) if weight is not None else F.lit(0)).first()
    return F.broadcast(df) if n <= rows and total <= most else df
