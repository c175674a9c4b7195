"""Session helpers shared by all operators: sessions, durable cuts of lineage, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quern")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a temporary one only on a local master that names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "quern-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


def folder_path(path: str) -> str:
    """A path of the local or a mounted file system without its scheme."""
    return path.split(":", 1)[1].replace("///", "/", 1) if path.startswith("file:") else path


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared checkpoint folder, from which a lost executor's part is read again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared checkpoint folder: compressed, and read by column."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def only_ids(df: DataFrame, ids: DataFrame, keep: bool, limit: int = 2_000_000, key: str = "id") -> DataFrame:
    """Rows of df whose key is (keep) or is not among ids (one column, distinct); at most `limit` ids are broadcast, more are joined by shuffle."""
    n = ids.count()
    if n == 0:
        return df.limit(0) if keep else df
    return df.join(F.broadcast(ids) if n <= limit else ids, key, "left_semi" if keep else "left_anti")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size; huge when it doesn't know."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(stats.sizeInBytes().toString())


def broadcast_if_small(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """Hint a broadcast only when the optimizer's estimate is under the limit; otherwise a shuffle join remains."""
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About `rows` rows chosen by the hash of their keys, never more than a quarter above that; all, where there are fewer."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < share).limit(rows + rows // 4)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    marker = f"quern-{sc.applicationId}"
    if getattr(ship_package, "done", None) == marker:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quern-ship-")
    path = os.path.join(folder, "quern_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("quern", os.path.relpath(full, here)))
    sc.addPyFile(path)
    ship_package.done = marker
