"""Session helpers: tables, staged tables in the shared folder, shipping the package."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_WIDE = re.compile(r"^[\W\d]*(?:Join|Aggregate|Distinct|Window|Sort|Repartition\w*|Intersect|Except|GlobalLimit)\b", re.M)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session: it need not be on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(folder := tempfile.mkdtemp(), "corpusloom.zip")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(target, "w") as z:
        for root, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(root, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(here)))
    spark.sparkContext.addPyFile(target)


def hash_sample(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df``, those whose hash of ``key`` is low; all if it has no more. Needs the number of rows, no sort."""
    n = df.count() if total is None else total
    if n <= rows:
        return df
    return df.where(F.xxhash64(F.lit(17), key) < F.lit(int(-(2**63) + 2**64 * rows / n)).cast("long"))


#: Bytes a core up to which a table of fewer files than cores is spread: its row groups may be fewer than its splits.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a table in one row group is otherwise one task's work.

    A plan that shuffles is left as it is, as asking for its partitions would run its shuffles.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if _WIDE.search(plan.toString()):
        return df
    small = int(str(plan.stats().sizeInBytes())) <= n * SMALL and len(df.inputFiles()) < n
    return df.repartition(n) if small or df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A temporary one is set only where none is and all tasks run in this process (tests); on a cluster that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, so a lost executor costs no recomputation of what led to it.

    The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the table of a DataFrame that ``staged`` returned; nothing for any other."""
    if path := getattr(df, "_staged_at", None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone by then
            pass

    atexit.register(drop)
