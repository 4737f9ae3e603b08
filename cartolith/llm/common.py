"""What the operators of this subpackage share: tables, shared folder, columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    On a cluster that is ``spark.checkpoint.dir``, and it must be set.  Only
    on one machine (in tests) a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all machines share")
        folder = _LOCAL.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="shared-"))
    return folder.rstrip("/")


_LOCAL: dict[str, str] = {}


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Some texts are very long: Arrow batches of few rows keep workers small.

    The session's own setting comes back at the end, so what is to run under it
    has to run inside (see ``written``).
    """
    before = spark.conf.get(BATCH_ROWS, None)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_ROWS) if before is None else spark.conf.set(BATCH_ROWS, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: what is lost with an executor after this is read again
    from the shared folder, not computed again.  The shuffle files of the write
    serve nothing after it and are deleted with its end, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the tables that ``written`` made, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_folder(spark)
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.startswith(root) or folder.replace("file:///", "file:/").startswith(root.replace("file:///", "file:/")):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
