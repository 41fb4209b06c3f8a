"""Where intermediate tables go, and how large a side may be before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Largest number of bytes a side may have, by the optimizer's own estimate or an exact
#: count times a row width, before it is broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else (tests) a local one.

    A machine-local folder is only taken when the session runs in one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    made = "file://" + tempfile.mkdtemp(prefix="archivolt-")
    context.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table; removed when the JVM ends."""
    path = f"{shared_dir(spark)}/archivolt/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later step reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    return settle_at(df, new_path(df.sparkSession, name))


def settle_at(df: DataFrame, path: str) -> DataFrame:
    """As ``settle``, to a folder that ``remove`` can free before the JVM ends."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when the query that wrote them ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="archivolt-")) / "archivolt.zip"
        with zipfile.ZipFile(archive, "w") as made:
            for file in sorted(package.rglob("*.py")):
                made.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory; the package is shipped for what comes after."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
