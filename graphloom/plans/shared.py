"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder of our own only where it is unset on a local master.

    On a cluster every executor would write such a folder on its own disk, so there an unset folder is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost no recomputation.

    With ``rows``, about how many there are, loops over small tables write a file per 20,000 rows, not one per partition.
    """
    path = new_dir(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(rows // 20_000 + 2)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, as loops do with the rounds they have merged."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def merged(tables: list[DataFrame], label: str, keep: DataFrame | None = None, limit: int = 8) -> list[DataFrame]:
    """The same rows in one table once there are more than ``limit``; all of them but ``keep`` are then deleted."""
    if len(tables) <= limit:
        return tables
    one = materialize(reduce(DataFrame.unionByName, tables), label)
    drop_tables(*(t for t in tables if t is not keep))
    return [one]
