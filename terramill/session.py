"""Session helpers: the shared scratch folder, lineage cuts and table reading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting: it gets a temporary
    folder of its own, which is entered in the session.
    """
    root = spark.conf.get(CHECKPOINT, None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError(f"set {CHECKPOINT} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="terramill-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    spark.conf.set(CHECKPOINT, f"file://{root}")
    return f"file://{root}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written intermediate tables of one operator run.

    ``cut`` writes a DataFrame once and returns it read back: later stages
    don't recompute it, it survives lost executors, and the planner knows its
    size, so that a small one is broadcast and a large one is not.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/terramill/{name}-{uuid.uuid4().hex}"
        if self.root.startswith("file://"):
            atexit.register(shutil.rmtree, self.root[7:], ignore_errors=True)
        else:  # goes with the driver
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            files.mkdirs(at)
            files.deleteOnExit(at)

    @staticmethod
    def fresh() -> str:
        return uuid.uuid4().hex

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete_path(self.spark, self.path(name))


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_terramill_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="terramill-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "terramill.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path("terramill", source.relative_to(package)))
    context.addPyFile(str(archive))
    context._terramill_shipped = True
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Partitions to give an explicit exchange."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
