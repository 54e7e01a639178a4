"""Session helpers: local sessions for tests and the bench, and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "coldledger") -> SparkSession:
    """A single-machine session for tests and measurements."""
    partitions = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="coldledger-")
    return _own_folders[application]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for operators that run Python there."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="coldledger-ship-")) / package.name
        # Spark copies the file to every executor, so the driver's own disk will do.
        archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """Path of a fresh folder inside the shared one (not yet created)."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store that Spark can write to; none is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Staging:
    """Owner of the tables that ``durable`` writes while ``recording``, until ``release`` deletes them."""

    def __init__(self) -> None:
        self.folders: list[str] = []

    @contextmanager
    def recording(self) -> Iterator[Staging]:
        token = _owner.set(self)
        try:
            yield self
        finally:
            _owner.reset(token)

    def release(self, spark: SparkSession) -> None:
        while self.folders:
            delete_folder(spark, self.folders[-1])
            self.folders.pop()


_owner: ContextVar[Staging | None] = ContextVar("staging", default=None)


@contextmanager
def staged(spark: SparkSession) -> Iterator[Staging]:
    """Delete at the end what ``durable`` writes within; results must be written out before that."""
    owner = Staging()
    try:
        with owner.recording():
            yield owner
    finally:
        owner.release(spark)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and carry on from that.

    For results that several branches read: they are computed once, readers take
    only the columns they need, the planner knows the size, and a lost executor
    costs a re-read instead of the whole lineage. The table stays until its
    ``Staging``, if there is one, is released.
    """
    path = new_folder(df.sparkSession, "table")
    owner = _owner.get()
    if owner is not None:
        owner.folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fixed_partitions(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: its partitions and the order of rows in them stay as they are."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def mounted_path(folder: str) -> str:
    """``folder`` as a file-system path, for work done with plain file calls."""
    if folder.startswith("file:"):
        return "/" + folder[len("file:") :].lstrip("/")
    if "://" in folder:
        raise ValueError(f"{folder} is not mounted as a file system on the executors")
    return folder
