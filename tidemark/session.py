"""Session settings and the cutting of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: dict[str, str] = {}


def build_session(app: str = "tidemark", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A session for local work: UTC, AQE on, few shuffle partitions. A cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def use_checkpoints(spark: SparkSession) -> None:
    """The folder of ``spark.checkpoint.dir`` holds for all checkpoints. Where it is unset, a local
    session gets a temporary folder; a cluster must name a folder that all executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return
    if spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    spark.sparkContext.setCheckpointDir(_OWN_DIR[app])


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and reads it from there: later stages don't compute it
    again, and the loss of an executor loses nothing of it."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name beside the checkpoints, where all executors reach it."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def if_small(df: DataFrame, rows: int = 500_000, megabytes: int = 64) -> DataFrame:
    """``df`` (cut before, for it is read) marked for a broadcast if it has at most ``rows`` rows of at most
    ``megabytes`` together, counted by their contents; beyond that the join shuffles."""

    def width(c: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        return F.lit(8)

    widths = [width(f"`{f.name}`", f.dataType) for f in df.schema.fields]
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(widths, F.lit(8)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= megabytes << 20 else df
