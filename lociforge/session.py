"""Session helpers: configuration, table access and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lociforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all tasks run on this machine, an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="spark-cut-")
    return _OWN_FOLDER[app]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of plans that are made and run in the block go with the end of each."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


class Cut:
    """Tables written to the shared folder to cut lineage; ``drop`` removes those no longer needed, ``close`` all.

    ``with Cut(spark) as cut:`` closes it at the end of the block, where the result must have been written. What is
    still open when Python exits, or at ``close_cuts``, is closed then.
    """

    _open: ClassVar[dict[str, SparkSession]] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
        self.count = 0
        Cut._open[self.folder] = spark

    def __enter__(self) -> Cut:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        if Cut._open.pop(self.folder, None) is not None:
            _delete(self.spark, self.folder)

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` once and read it back: one pass, on files that every executor can reach.

        The shuffle files of the pass go with its end, not when the driver happens to collect its garbage: the plan of a
        write runs once, and what is written is all that later plans read.
        """
        path = f"{self.folder}/{self.count}"
        self.count += 1
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with shuffles_dropped(self.spark):
            writer.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._cut_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``write`` gave and that no later plan reads."""
        for df in tables:
            path = getattr(df, "_cut_path", None)
            if path:
                _delete(self.spark, path)


def open_cuts() -> frozenset[str]:
    """The folders of the cuts that are open."""
    return frozenset(Cut._open)


def close_cuts(keep: frozenset[str] = frozenset()) -> None:
    """Delete the tables of all cuts but some: once the results that read them are written, or at the end."""
    for folder, spark in list(Cut._open.items()):
        if folder in keep:
            continue
        Cut._open.pop(folder)
        try:
            _delete(spark, folder)
        except Exception:  # noqa: BLE001, S110
            pass  # the session has ended; the folder's owner clears it


atexit.register(close_cuts)
