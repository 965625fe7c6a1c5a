"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "cairn", cpus: int | None = None) -> SparkSession:
    """A local session with the settings that tests and the benchmark use.

    On a cluster the session comes from spark-submit and nothing here is called.
    """
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset on a local master (tests, a laptop) a temporary folder takes its place and
    becomes the session's checkpoint folder; on a cluster it is an error, as executors and driver
    would each write to a disk of their own. Hadoop removes the fresh folder when the session ends.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    That cuts the lineage with files which survive the loss of an executor.
    """
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, each: int = 4) -> DataFrame:
    """Rows dealt out evenly to ``each`` tasks a core, for steps that cost much a row.

    A table that is small on disk, or one row group, is otherwise read by a task or a few, which then have all the work.
    """
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism)


def tasks_of(spark: SparkSession, each: int = 4) -> int:
    """Tasks of a shuffle whose work is more than its bytes tell: ``each`` a core, or those that the session sets if they are more."""
    return max(each * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrow_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Bound the rows and bytes of an Arrow batch, since documents can be long.

    Plans read the setting when they run, so it stays set for the session; it bounds memory only.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """Integers of which ``repartition(n, column)`` sends the i-th to partition i.

    They deal rows that name their partition out evenly, where hashes of 0 to n - 1 would collide.
    """
    found = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id"))
    keys = {r["p"]: r["id"] for r in found.collect()}  # one row a partition
    return [keys.get(i, i) for i in range(n)]
