"""SparkSession factory and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "millrace", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and benchmarks share: UTC, AQE on, ANSI left on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.executorEnv.PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))  # workers find the package wherever they start
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def package_zip(path: str) -> str:
    """The package as a zip file at ``path``, for ``--py-files`` or ``addPyFile``, so that workers elsewhere can import it."""
    home = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(home)):
            for name in sorted(n for n in names if n.endswith(".py")):
                whole = os.path.join(folder, name)
                out.write(whole, os.path.relpath(whole, os.path.dirname(home)))
    return path


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temp folder where it is unset and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster intermediate tables need a folder that driver and executors share")
    return (found or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs that start inside hand rows to Python in batches of at most ``size`` bytes, which bounds both sides' buffers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and survive lost executors.

    ``table`` writes a frame and reads it back; ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, frame: DataFrame) -> DataFrame:
        frame.write.parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        time.sleep(1.5)  # the JVM hears of dropped Python references a second later
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
