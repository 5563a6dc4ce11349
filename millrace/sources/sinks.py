"""Sinks: text, JSON lines, archives. Each task writes its own part; nothing passes through the driver whole."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import Scratch
from millrace.sources.archives import located


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("overwrite").text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def zipped(files: DataFrame, folder: str = "folder") -> DataFrame:
    """One archive for each folder of (folder, path, content): folder, archive. A folder's files must fit a task."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(part["path"], part["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(path), content)
        return pd.DataFrame({"folder": [part["folder"].iloc[0]], "archive": [out.getvalue()]})

    return files.select(F.col(folder).alias("folder"), "path", "content").groupBy("folder").applyInPandas(pack, "folder string, archive binary")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """``<root>/<name>`` of each (name, content): path and length of what was written. A file is whole before it has its name."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = located(root)
        store.create_dir(base, recursive=True)
        for part in parts:
            for name, content in zip(part["name"], part["content"], strict=True):
                unfinished = f"{base}/.{uuid4().hex}"
                with store.open_output_stream(unfinished) as out:
                    out.write(content)
                store.move(unfinished, f"{base}/{name}")
            yield pd.DataFrame({"path": [f"{root}/{n}" for n in part["name"]], "length": [len(c) for c in part["content"]]})

    return Scratch(files.sparkSession, "files").table("written", files.select("name", "content").mapInPandas(write, "path string, length long"))
