"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "credsweep") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables, as the session names it.

    ``spark.checkpoint.dir`` (or the context's own setting) must name it.  Only a
    session whose executors are threads of this process may go without: it gets a
    fresh folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="credsweep-ckpt-"))
    return sc.getCheckpointDir()
