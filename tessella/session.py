"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tessella", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.worker.reuse", "true")
        .getOrCreate()
    )


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may fall back to a
    folder on this machine: other executors could not read it.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        base = _LOCAL_SCRATCH.get(app) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _LOCAL_SCRATCH[app] = base
    return f"{base}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage, keeps column pruning and statistics for the readers, and survives the
    loss of executors, which cached or locally checkpointed blocks do not.

    Joins on the table are merge joins: its files may be small enough for a broadcast while its rows, packed to almost
    nothing in the files, take a hundred times as much in the driver. Small tables are broadcast by name.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path).hint("merge")
