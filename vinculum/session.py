"""Session helpers: shared storage for cut lineage and table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = f"vinculum-{uuid.uuid4().hex}"
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, named by ``spark.checkpoint.dir``.

    Only on one machine (a local master) may that setting be absent; a temporary folder is then made, and removed at exit. On a
    cluster its absence is an error, as no folder of the driver's machine is seen by the executors.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="vinculum-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _sweep(spark: SparkSession, folder: str) -> None:
    """Remove the cuts of this run, as far as its session still lives; local folders are removed in any case."""
    try:
        _delete(spark, folder)
    except Exception:  # noqa: BLE001  the session has ended
        shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it once to the shared folder as Parquet and read it again.

    Survives the loss of executors (the files are on shared storage) and computes the plan exactly once. The files live in a
    folder of this run, which is removed when the process ends; ``discard`` removes them earlier.
    """
    spark = df.sparkSession
    run = f"{shared_dir(spark)}/{_RUN}"
    if run not in _MADE:
        _MADE.add(run)
        atexit.register(_sweep, spark, run)
    path = f"{run}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` returned, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Have the driver's garbage collected, as Spark drops the shuffle files of what was cut only when its plans are; a no-op where the
    driver's process can't be reached. Only for cuts whose shuffle is about as large as the input."""
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # noqa: BLE001
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
