"""Session defaults and the few helpers that depend on cluster settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "framesafe") -> SparkSession:
    """A session for tests and benches; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset
    (tests, a laptop) is a folder of our own used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="framesafe-ckpt-"))
    return df.checkpoint(eager)


def fits_in_broadcast(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` is proven to have at most ``max_rows`` rows; reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only behind the size check; otherwise the join shuffles as usual."""
    return F.broadcast(df) if fits_in_broadcast(df, max_rows) else df


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Partition by ``cols`` into the session's number of shuffle partitions.

    For stages that do heavy work per row: an explicit number keeps adaptive execution from packing
    small inputs into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)
