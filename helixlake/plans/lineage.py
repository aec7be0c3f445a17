"""Cutting lineage with tables in the folder that all executors share."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Paths made by this process and not removed yet.
_LIVE: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of this process, removed at its end, if the master is
    local; on a cluster an error, since executors couldn't see a folder of one machine."""
    conf = spark.sparkContext.getConf()
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="helixlake-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; see `intermediates` for its removal."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _LIVE[path] = None
    return path


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: later stages no longer depend on its shuffles or executors."""
    path = path or new_path(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete paths of the shared folder that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _LIVE.pop(path, None)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what operators wrote to the shared folder inside. A result is lazy and reads such tables, so the
    action that consumes it belongs inside as well."""
    before = set(_LIVE)
    try:
        yield
    finally:
        remove(spark, *(p for p in list(_LIVE) if p not in before))


def _at_end() -> None:
    spark = SparkSession.getActiveSession() if _LIVE else None
    if spark is not None:
        try:
            remove(spark, *list(_LIVE))
        except Exception:  # noqa: BLE001  (the session is gone: the folder's owner cleans up)
            pass


atexit.register(_at_end)
