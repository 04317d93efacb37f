"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_written: list[str] = []


def build_session(app: str = "recordweave", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the engine is tested with; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in ``spark.checkpoint.dir``; only a local session without
    that setting (tests) gets a folder of its own, which goes when the process ends."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"name a folder that all executors share in {CHECKPOINT_KEY}; {master} has none")
        folder = tempfile.mkdtemp(prefix="recordweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
        spark.conf.set(CHECKPOINT_KEY, named)
    return named.rstrip("/")


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    This cuts lineage without executor-local blocks, so a lost executor costs a re-read only. ``release`` removes what
    was written once the results that read it are used.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/recordweave/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes every table that ``materialise`` wrote in this process; how many. DataFrames that read them can no longer run."""
    gone = 0
    while _written:
        gone += delete(spark, _written.pop())
    return gone


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a folder of any file system Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, which need not have it installed; once per context."""
    context = spark.sparkContext
    if getattr(context, "_recordweave_shipped", False):
        return
    package = pathlib.Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="recordweave-")  # the driver serves the archive from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = pathlib.Path(folder) / "recordweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._recordweave_shipped = True


def ship_file(spark: SparkSession, path: str) -> str:
    """Give a file of the driver to all workers; the name under which ``SparkFiles.get`` finds it there."""
    if path not in (sent := getattr(spark.sparkContext, "_recordweave_files", set())):
        spark.sparkContext.addFile(path)
        spark.sparkContext._recordweave_files = sent | {path}
    return pathlib.PurePosixPath(path).name


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` in bytes (an upper bound for scans and projections)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
