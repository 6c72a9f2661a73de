"""Session helpers that work the same on a laptop and on a cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Settings under which a Python worker gives memory back that it has freed: two arenas, a low threshold, and no pool of Arrow's own.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1000000", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: The same for work on many arrays of some MB: below 16 MB they reuse the heap, as mappings of their own are zeroed page by page.
ARRAY_MEMORY = WORKER_MEMORY | {"MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}
_PUT: dict[str, str] = {}


def ship(spark: SparkSession, memory: dict[str, str] = WORKER_MEMORY) -> None:
    """Let Python workers import this package where they share the driver's files.

    On a cluster the package travels by ``--py-files``; the extra path is then
    simply absent on the executors.  Functions made until the next call run in
    workers with the settings ``memory``, but for those the session has itself.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    for name in [n for n, value in _PUT.items() if env.get(n) == value]:
        del env[name]
    _PUT.clear()
    _PUT.update({name: value for name, value in memory.items() if name not in env})
    env.update(_PUT)
    # Texts can be long: few rows to a batch keep a worker's memory low.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests) a temporary one is
    made; on a cluster the executors could not see it, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Intermediate tables in the shared folder; ``with`` keeps none but those kept.

    A table written here cuts the lineage: executors may be lost, the rows stay.
    Kept tables go by :func:`release`, or at the latest when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made: list[str] = []
        self.kept: set[str] = set()

    def save(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{len(self.made)}-{name}"
        self.made.append(path)
        if keep:
            self.kept.add(path)
        df.write.parquet(path)
        if len(self.made) == 1:
            _file_system(self.spark, self.root)[0].deleteOnExit(_file_system(self.spark, self.root)[1])
            _ROOTS.append(self.root)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *_) -> None:
        for path in self.made:
            if path not in self.kept:
                self.drop(path)

    def drop(self, path: str) -> None:
        delete(self.spark, path)

    def drop_last(self) -> None:
        self.drop(self.made[-1])


#: Folders of the workspaces that this process has written to.
_ROOTS: list[str] = []


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that results of this process were kept in; to be called once those results are written."""
    while _ROOTS:
        delete(spark, _ROOTS.pop())


@contextmanager
def scratch(spark: SparkSession, keep: Workspace):
    """Inside, results are written to ``keep``; all other tables that were kept for them meanwhile go at the end."""
    before = {*_ROOTS, keep.root}
    yield
    for root in [r for r in _ROOTS if r not in before]:
        _ROOTS.remove(root)
        delete(spark, root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, for work that is heavy to a row, where the input has fewer partitions than the cluster cores.

    A large input has more partitions than cores and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows
