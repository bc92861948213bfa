"""Tables in the folder that all executors share; they cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_REMOVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on this machine alone."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-ledgerloom-")
    return _own_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledgerloom-{spark.sparkContext.applicationId}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes a job's shuffle files when the job ends, not at some later collection of the driver's garbage; no other job reads them."""
    before = spark.conf.get(_REMOVE, None)
    spark.conf.set(_REMOVE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE)
        else:
            spark.conf.set(_REMOVE, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    A lost executor then costs a re-read, never a recomputation that could come out differently. The tables of a session
    lie under one folder named after the application; discard() removes one of them, discard_all() the folder.
    """
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, wanted: DataFrame | None = None) -> DataFrame:
    """Like table(), with the rows in buckets by a hash of the key: joins on it then shuffle only their other side.

    Only rows whose key is wanted are kept, if keys are given; the shuffle into buckets serves that join too. There are as
    many buckets as shuffle partitions. The table is external, so only its folder holds data.
    """
    spark, unique = df.sparkSession, f"ledgerloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, key)
    dealt = dealt if wanted is None else dealt.join(wanted, key, "left_semi")
    with _shuffles_removed(spark):
        dealt.write.bucketBy(buckets, key).option("path", f"{_folder(spark)}/{name}-{unique}").saveAsTable(unique)
    return spark.table(unique)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that an operator of this library made itself."""
    _delete(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share, for an operator that keeps several tables."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Removes a table that nothing reads any more. Only folders that table() made are removed."""
    folder = _folder(df.sparkSession).split("://")[-1].lstrip("/")
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder in parent:
            _delete(df.sparkSession, parent)


def discard_all(spark: SparkSession) -> None:
    """Removes all tables of this session."""
    _delete(spark, _folder(spark))
