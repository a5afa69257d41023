"""Session settings and the few helpers that touch the cluster's configuration."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings this library is tested with."""
    b = (
        SparkSession.builder.master(master)
        .appName("voxgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One parquet table of a data directory, pruned to cols where given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


_LOCAL: list[str] = []
_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where none is set.

    The temporary folder is only for local runs, one for the process, and removed at its end; a cluster names its own in the session.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="voxgrid-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: its lineage ends there.

    A result that several later steps use is computed once, and a lost executor costs only a re-read.
    """
    path = f"{shared_dir(df.sparkSession)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> int:
    """Removes every staged table of the process; results that were built on them can't be read afterwards. Their number."""
    n = len(_STAGED)
    for spark, path in _STAGED:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _STAGED.clear()
    return n
