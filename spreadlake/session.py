"""Session defaults and the durable folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", partitions: int = 8, extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own.

    Call-site capture is off: it costs several gateway calls per expression.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("spreadlake")
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are pickled by reference; workers find
    the package whatever the driver's working directory or path is.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "spreadlake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; fall back only where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


_STAGED: list[str] = []


def staging_folder(spark: SparkSession) -> str:
    """The shared folder for tables of a job."""
    ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def stage(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Used where the same wide intermediate feeds two branches (a per-segment
    summary and the rows themselves).  The files are compressed and read by
    column, a lost executor's tasks reread them, and the optimizer sees their
    true size, so joins with small ones are broadcast by bytes.  A filter on the
    columns ``by`` reads only their folders.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/stage-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> None:
    """Delete the staged tables, once no result that reads them is needed."""
    context = spark.sparkContext
    while _STAGED:
        path = context._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
