"""Session helpers.

The library never creates a cluster session on its own: callers pass a
``SparkSession``.  ``local_session`` exists for tests, scripts and the bench.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tillroll") -> SparkSession:
    """A local session tuned for small scale factors (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset
    (local tests) fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; ordered operators need a shared "
                "checkpoint folder on a cluster")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: For writes of wide lines.  Spark drops an execution's shuffle files when it
#: ends, not when the driver happens to collect its garbage; and generated methods
#: that are too long for the JVM to compile are not used.
WRITE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
              "spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """WRITE_CONF holds inside, for writes only: each is an execution of its own,
    whose shuffles nothing reads again."""
    before = {k: spark.conf.get(k, None) for k in WRITE_CONF}
    try:
        for k, v in WRITE_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df, label: str = "stage", partition_by: str | None = None, compact: bool = False):
    """Write ``df`` as a Parquet table under the checkpoint folder and read it
    back: the lineage is cut (a lost executor restarts from the table, not
    from the sources) and later readers get column pruning.  ``compact``, for
    tables of all lines: compressed with zstd, and the shuffle files that the
    write needed are dropped after it."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    if compact:
        with lean_writes(spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path, partitionBy=partition_by)
    else:
        df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    if partition_by:  # a table without rows has no folder to take the schema from
        return spark.read.schema(schema).parquet(path)
    return spark.read.parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that the library has written, where Spark writes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df) -> None:
    """Delete the tables of ``materialize`` that ``df`` reads; nothing may read
    them after.  Other files that ``df`` reads stay."""
    spark = df.sparkSession
    tables = re.sub(r"^\w+:(//[^/]*)?/*", "/", ensure_checkpoint_dir(spark).rstrip("/")) + "/tables/"
    cut = [f.partition(tables) for f in df.inputFiles()]
    for folder in {f"{head}{mark}{rest.split('/')[0]}" for head, mark, rest in cut if mark}:
        delete_folder(spark, folder)
