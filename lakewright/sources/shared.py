"""Tables in the folder that all executors share, for cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only a purely local session without that setting gets a temporary folder
    of its own; on a cluster a missing setting is an error, since a
    machine-local folder would not be visible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lakewright-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def release() -> None:
    """Delete every table written so far; call it once the results that read them are consumed."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; the folder is scratch space
            pass


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` but evaluates the plan once,
    and later readers prune columns.  The table outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._lakewright_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialise` that no later plan reads."""
    path = getattr(df, "_lakewright_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]
