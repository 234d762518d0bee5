"""Session set-up and the few helpers that need the session: table loading, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast after its rows were counted.
BROADCAST_ROWS = 20_000

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "spindrift", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the engine's defaults; a session that runs already is returned as it is."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of Parquet tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. Only a session in one process (``local[...]``) that
    sets none gets a temporary folder; on a cluster no folder of one machine would do, so that this is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to a table in the shared folder and read again.

    Later stages don't compute it a second time, its lineage is gone, and the loss of an executor costs nothing, as
    the files lie outside the executors. Columnar files are a fraction of what ``checkpoint()`` writes and keep
    column pruning and filter pushdown. :func:`purge` removes them."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "spindrift", spark.sparkContext.applicationId, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Remove every table that :func:`cut` wrote in this application. DataFrames that read them end working."""
    folder = os.path.join(shared_dir(spark), "spindrift", spark.sparkContext.applicationId)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``rows`` rows, else ``df`` as it is, so that the join shuffles.

    The rows are counted first (and only up to the bound), so ``df`` should be cheap to compute."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``one``, a table of one row (an aggregate without keys), which is broadcast."""
    return rows.join(F.broadcast(one.limit(1)), F.lit(True))
