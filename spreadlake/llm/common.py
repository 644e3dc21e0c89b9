"""Shared helpers: tables, words as bytes, and tables staged in the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a text in which A-Z is lower-cased and ASCII white space (09-0D, 20) becomes a space.
SPACED = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: As above, and every ASCII byte that is no letter or digit becomes a space.
ALNUM = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None, alphabet: bytes = SPACED) -> list[bytes]:
    """Words of a whole text as UTF-8 bytes; ``bytes.split`` cuts at 09-0D and 20 only."""
    return text.translate(alphabet).split() if text else []


def text_bytes(name: str) -> Column:
    """A text column as UTF-8 bytes, null as empty: Python gets it without decoding."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, so extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir() or named
    return named.rstrip("/")


#: Spark deletes the shuffle files of a query when it ends, instead of when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, was)


_STAGED: list[str] = []
_SCOPES = threading.local()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor's tasks reread files.  The optimizer sees
    the true size of the files, so a later join broadcasts only what is small.
    Nothing reads the shuffles behind it any more, so their files go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    _STAGED.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    for scope in getattr(_SCOPES, "open", []):
        scope[path] = table
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables staged inside when the block ends, but for those passed to what it yields.

    Nothing that is read later may be left unstaged: a kept table has to be a
    staged one itself.
    """
    scope: dict[str, DataFrame] = {}
    kept: list[DataFrame] = []
    _SCOPES.open = [*getattr(_SCOPES, "open", []), scope]

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _SCOPES.open = _SCOPES.open[:-1]
    for path, table in scope.items():
        if not any(table is k for k in kept):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _STAGED:
        _STAGED.remove(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete the tables staged so far, once nothing that reads them is needed."""
    while _STAGED:
        _delete(spark, _STAGED[-1])
