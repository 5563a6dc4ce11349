"""Results that are kept under a fingerprint of their plan and input files, and read again while both stay the same."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import scratch_root
from millrace.sources.stored import delete_path


def plan_text(frame: DataFrame) -> str:
    """The plan with its expressions' numbers taken out, so that the same query built again gives the same text."""
    conf, name = frame.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(name, None)
    conf.set(name, str(1 << 30))  # no shortened lists of columns
    try:
        # Python functions are shown by name alone, so their code is what ``version`` has to tell.
        return frame._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def files_state(frame: DataFrame) -> tuple[int, int, int]:
    """How many files the frame reads, their bytes, and a sum of hashes of path, length and time. Tasks list and hash them."""
    paths = frame.inputFiles()
    if not paths:
        return 0, 0, 0
    listed = frame.sparkSession.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    n, size, total = listed.agg(F.count("*"), F.sum("length"), F.sum(mark)).first()
    return n, size or 0, int(total or 0)


def fingerprint(frame: DataFrame, version: str = "") -> str:
    text = "\n".join([re.sub(r"#\d+L?", "#", plan_text(frame)), repr(files_state(frame)), frame.schema.json(), version])
    return hashlib.sha256(text.encode()).hexdigest()


def _kept(spark: SparkSession, folder: str) -> list[str]:
    """The whole copies below a folder, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(at)]
    return [p for _, p in sorted(found) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]


def reused(frame: DataFrame, name: str, root: str | None = None, refresh: bool = False, version: str = "") -> DataFrame:
    """The rows of ``frame`` as a stored table, computed only if no copy has its fingerprint, or ``refresh`` asks for it.

    Build the frame anew for each call: a frame knows the files that were there when it was made. Everything else that can change a result without
    showing in plan or files, such as the code of a Python function, belongs into ``version``. Rows made up in the driver have no
    files, but stand in the plan. Each copy has a folder of its own and appears whole or not at all, so callers may race; then
    the oldest is read. Copies of other fingerprints stay until ``forget``, as others may be reading them.
    """
    spark = frame.sparkSession
    folder = f"{(root or scratch_root(spark)).rstrip('/')}/results/{name}/{fingerprint(frame, version)}"
    kept = _kept(spark, folder)
    if refresh or not kept:
        made = f"{folder}/{uuid.uuid4().hex}"
        frame.write.parquet(made)
        for old in kept:
            delete_path(spark, old)
        kept = [made] if refresh else _kept(spark, folder)
    return spark.read.schema(frame.schema).parquet(kept[0])


def forget(spark: SparkSession, name: str, root: str | None = None) -> None:
    """Remove all copies of a name."""
    delete_path(spark, f"{(root or scratch_root(spark)).rstrip('/')}/results/{name}")
