"""Session-level helpers: where intermediate tables are written, and how lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session with a ``local`` master may go without the setting (tests); it gets a temporary folder.
    On a cluster a missing setting is an error, as a machine-local folder would not survive there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = path = tempfile.mkdtemp(prefix="fixloom-")
        sc.setCheckpointDir(path)
        atexit.register(shutil.rmtree, path, True)
    return _LOCAL[sc.applicationId]


def written(df: DataFrame, name: str = "t", *by: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, safe against lost executors.

    Parquet keeps it columnar and compressed, so later readers prune columns; with ``by``, the columns that name its
    folders, they prune rows as well. The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fixloom-{_RUN}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
