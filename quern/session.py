"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINT_DIR = "file:///tmp/checkpoints/quern"


def build_session(app: str = "quern", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use.

    On a cluster the caller's own session is used instead; no operator depends on
    a setting made here.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the session is local (one machine), a folder of
    our own is used; on a cluster an unset value is an error, since a
    machine-local folder would not be seen by the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_CHECKPOINT_DIR
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows rereads the files, also after an executor
    is lost, and adaptive execution sees exact sizes. The files go when the
    application's file system is closed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the session has cores.

    A small input in one file is one task; work that is heavy per row is then dealt over
    all cores. Inputs with enough splits, as large ones have, stay where they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Python workers get Arrow batches of about ``size`` bytes at most from what runs inside; results do not depend on it.

    Rows of long lists fill Spark's own 64 MB, which a task holds several times over. A smaller limit of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    digits = (before or "").rstrip("b")
    if digits.isdigit() and int(digits) <= size:
        yield
        return
    spark.conf.set(key, f"{size}b")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for Python workers, once per application.

    Workers of a cluster need not have it installed: Spark's own file server hands them
    a zip of the sources.
    """
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        folder = tempfile.mkdtemp(prefix="quern-")  # local sessions read the file in place
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/quern_sources.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(f"{folder}/quern_sources.zip")
    context._quern_shipped = True
