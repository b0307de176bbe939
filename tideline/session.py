"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark deletes the shuffle files of an execution at its end; else they stay until the driver collects garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, app: str = "tideline", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Unset is accepted in local mode only: on a cluster a folder of one machine
    would be lost with that machine.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tideline-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from the table.

    Survives lost executors, every reader sees the same rows, and later passes read
    only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    owner = _owner.get()
    if owner is not None:
        owner.add(path, lambda: delete_folder(spark, path))
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: nothing reads them once the table is there."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


class Scratch:
    """Owner of what is written inside its ``with`` block: all but the kept goes at the end.

    ``materialise`` announces its tables here. What is kept passes to the block around, if
    there is one, else it stays. A result handed out of the block must not read a table that
    is not kept: keep it, or ``materialise`` the result inside.
    """

    def __init__(self) -> None:
        self._held: dict[str, Callable[[], object]] = {}
        self._kept: set[str] = set()

    def add(self, name: str, remove: Callable[[], object]) -> None:
        """``remove`` deletes what is known as ``name``."""
        self._held[name] = remove

    def keep(self, table: DataFrame) -> DataFrame:
        """All tables that ``table`` reads stay."""
        self._kept |= {folder.rsplit("/", 1)[-1] for folder in _folders(table)}
        return table

    def __enter__(self) -> Scratch:
        self._outer = _owner.get()
        self._token = _owner.set(self)
        return self

    def __exit__(self, *_) -> None:
        _owner.reset(self._token)
        for name, remove in self._held.items():
            if name.rsplit("/", 1)[-1] not in self._kept:
                remove()
            elif self._outer is not None:
                self._outer.add(name, remove)


_owner: ContextVar[Scratch | None] = ContextVar("tideline_scratch", default=None)


def owned(name: str, remove: Callable[[], object]) -> None:
    """Announce something written that the block around is to remove."""
    owner = _owner.get()
    if owner is not None:
        owner.add(name, remove)


def _folders(table: DataFrame) -> set[str]:
    """The folders of the files that a table reads."""
    return {file.rsplit("/", 1)[0] for file in table.inputFiles()}


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none if there is no such folder."""
    system, place = _file_system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in _folders(table):
        name = folder.rsplit("/", 1)[-1]
        if not re.fullmatch(r"table-[0-9a-f]{32}", name):
            raise ValueError(f"{folder} is not a table of materialise")
        delete_folder(spark, folder)
