"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}

#: Bounds of an Arrow batch that Python workers get.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of its own (tests); any
    other raises RuntimeError, for executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="tokensieve-")
        spark.conf.set("spark.checkpoint.dir", found)
        _track(spark, found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/tokensieve-{uuid.uuid4().hex}"
    _track(spark, path)
    return path


def store(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again; tables not stored here are left alone."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path and _written.pop(path, None):
            _delete(df.sparkSession, path)


def light(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table of narrow rows, to be broadcast in a join if it has at most so many (some 100 MB); as it is beyond."""
    return F.broadcast(table) if table.count() <= most else table


def drop(spark: SparkSession, path: str) -> None:
    """Delete what was written to a path of new_path()."""
    if _written.pop(path, None):
        _delete(spark, path)


def stored() -> set[str]:
    """The paths stored by now, as a mark for release_since."""
    return set(_written)


def release_since(mark: set[str], *keep: DataFrame) -> None:
    """Delete every table stored since the mark but those in keep.

    For callers that have consumed or stored an operator's result: a result
    reads the tables its operator stored, so they can't go before it.
    """
    spared = mark | {getattr(df, "_scratch", None) for df in keep}
    for path in [p for p in _written if p not in spared]:
        _delete(_written.pop(path), path)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go once the driver's JVM has collected their handles."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _track(spark: SparkSession, path: str) -> None:
    """Have the path deleted when the session's context stops, and by the JVM if it ends without that."""
    _written[path] = spark
    context = spark.sparkContext
    if "stop" not in vars(context):
        stop = context.stop

        def stop_clean() -> None:
            clean()
            del context.stop
            stop()

        context.stop = stop_clean
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clean() -> None:
    """Delete every table stored; those of a session that has ended are left to its JVM."""
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # its session has ended
            pass
        _written.pop(path, None)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a batch of long texts fits in a worker.

    Spark reads both settings when a plan runs, not when it is made, so they
    stay lowered for the session; smaller values are left as they are.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        found = spark.conf.get(key).lower().rstrip("b")
        if not found.lstrip("-").isdigit() or int(found) > most or int(found) <= 0:
            spark.conf.set(key, str(most))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    home = sys.modules.setdefault("_tokensieve_worker", types.ModuleType("_tokensieve_worker"))
    return home.__dict__.setdefault("cache", {})
