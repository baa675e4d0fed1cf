"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "lumbre") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where none is set, a local session
    (tests, benchmarks) takes a folder of this machine; a cluster raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "lumbre-checkpoints"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join. Rows with a null key match nothing; they are spread over all tasks by
    their other values instead of meeting in the one that null hashes to."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(f"`{k}`").isNull()
    spread = F.when(empty, F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes if not t.startswith("map")])).otherwise(F.lit(0))
    return left.withColumn("__null", spread).join(right.withColumn("__null", F.lit(0).cast("long")), [*keys, "__null"], "left").drop("__null")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; where
    executors lack that folder, install the package or pass it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
