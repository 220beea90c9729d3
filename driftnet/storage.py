"""Where operators keep intermediate tables.

On a cluster the folder named in ``spark.checkpoint.dir`` is shared by all
executors, so a table written there survives the loss of any of them.  Only
where that setting is absent and the master is local (tests, a laptop) is a
local folder made; elsewhere its absence is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, made once per application if unset."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share: intermediate tables are written there")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="driftnet-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: lineage ends here."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def stored_by(frame: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stored``, in buckets of ``key``: later joins on it do not shuffle this side.

    The frame should come from an aggregate or join on ``key``, whose partitions
    are the buckets, so each task writes its own."""
    spark = frame.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = f"driftnet_{name}_{uuid.uuid4().hex}".replace("-", "_")
    frame.write.format("parquet").bucketBy(buckets, key).option("path", fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)


# Bytes of input for each task of work that is heavy per row.
TASK_BYTES = 64 << 20


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` dealt out evenly, as many parts as its size asks for and at least one per core.

    Work of seconds per megabyte must not follow the layout of the files: one
    row group, or a group of long texts in it, would be one task.  The plan is
    the same at every size; only the number of parts grows.
    """
    if frame.isStreaming:
        return frame
    spark = frame.sparkSession
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Rows that come from no file have no known size: Spark then names the greatest there is.
    asked = -(-size // TASK_BYTES) if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(spark.sparkContext.defaultParallelism, asked))
