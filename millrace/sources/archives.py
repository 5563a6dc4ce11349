"""Byte ranges of files, members of ZIP archives, and archives written member by member.

Nothing here holds a whole file or archive: tasks open files through ``pyarrow.fs``, seek to what they need and read it in pieces.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.operators import scans
from millrace.session import Scratch, arrow_batches

CHUNK = 262_144
#: Bytes that one task reads, and bytes of a piece.
TASK, PIECE = 128 << 20, 4 << 20
#: The first size that a ZIP field of four bytes can't hold, and of two bytes.
WIDE, MANY = 0xFFFFFFFF, 0xFFFF


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark gives it, and the path there."""
    scheme, rest = re.fullmatch(r"(?:([a-zA-Z][a-zA-Z0-9+.-]+):)?(.*)", uri, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), re.sub("^//+", "/", rest)
    authority, path = re.fullmatch(r"//([^/]*)(.*)", rest, re.DOTALL).groups()
    store, base = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{authority}/")
    return store, f"{base.rstrip('/')}{path}" if base.strip("/") else path


class Ranges(InputPartition):
    """(path, length, first byte, bytes) of what one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.offset = int(options["offset"]) if "offset" in options else None
        self.limit = int(options.get("limit", CHUNK))
        if self.chunk < 1 or self.limit < 0 or (self.offset or 0) < 0:
            raise ValueError("chunks have a byte at least, ranges start at 0")

    def _files(self) -> list[tuple[str, int]]:
        store, base = located(self.root)
        found = store.get_file_info(base)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        if found.type == fs.FileType.File:
            return [(base, found.size)]
        below = store.get_file_info(fs.FileSelector(base, recursive=True))
        shown = [i for i in below if i.type == fs.FileType.File and not re.search(r"(^|/)[._]", i.path[len(base) :])]
        return sorted((i.path, i.size) for i in shown)

    def partitions(self) -> list[Ranges]:
        """Ranges in path order, dealt to tasks of some TASK bytes; a long file is cut between chunks."""
        tasks, size = [[]], 0
        step = max(TASK // self.chunk, 1) * self.chunk
        for path, length in self._files():
            if self.offset is not None:
                pieces = [(self.offset, max(min(self.limit, length - self.offset), 0))]
            else:
                pieces = [(at, min(step, length - at)) for at in range(0, max(length, 1), step)]
            for at, count in pieces:
                if tasks[-1] and size + count > TASK:
                    tasks, size = [*tasks, []], 0
                tasks[-1].append((path, length, at, count))
                size += count
        return [Ranges(t) for t in tasks]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = located(self.root)
        for path, length, first, count in partition.ranges:
            with store.open_input_file(path) as f:
                chunk = count if self.offset is not None else self.chunk
                for at in range(first, first + max(count, 1), max(chunk, 1)):
                    size = min(chunk, first + count - at)
                    yield path, length, at, size, at + size >= length, f.read_at(size, at) if size else b""


class ByteRanges(DataSource):
    """``spark.read.format("byte_ranges").load(path)``: files in chunks, or one range of each.

    Options: ``chunk``, bytes of a row of a whole file; ``offset`` and ``limit``, the only range that is read. Rows have the path,
    the file's length, offset, limit (bytes given), eof and content. An empty file has one empty row.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, length long, offset long, `limit` long, eof boolean, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RangeReader(dict(self.options))


def byte_ranges(spark: SparkSession, path: str, offset: int | None = None, limit: int = CHUNK, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``ByteRanges``: with an offset one range of each file, else all files in chunks."""
    spark.dataSource.register(ByteRanges)
    options = {"chunk": chunk} if offset is None else {"offset": offset, "limit": limit}
    return spark.read.format("byte_ranges").options(**{k: str(v) for k, v in options.items()}).load(path)


MEMBER = "archive string, number long, path string, at long, packed long, length long, crc long, method int, readable boolean"


def members(archives: DataFrame) -> DataFrame:
    """The central directories of the archives at ``path``, read alone: one row for each file inside, in stored order.

    Broken archives have none, nor do directories and paths that lead out. Members that are encrypted, or packed by anything but
    deflate, aren't ``readable``.
    """

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in MEMBER.split(", ")]
        for part in parts:
            for archive in part["path"].dropna():
                store, path = located(archive)
                try:
                    with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                        inside = [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("/") and ".." not in i.filename.split("/")]
                except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where it is too short to look for an end
                    continue
                for k in range(0, len(inside), 10_000):
                    found = [(archive, k + j, i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, i.compress_type in (0, 8) and not i.flag_bits & 1) for j, i in enumerate(inside[k : k + 10_000])]
                    yield pd.DataFrame(found, columns=columns)

    return archives.select("path").mapInPandas(listed, MEMBER)


def contents(found: DataFrame, piece: int = PIECE) -> DataFrame:
    """The readable ``members`` in pieces: archive, number, path, piece (from 0), content, and at a member's last piece ``intact``.

    Members are dealt by hash to tasks of some TASK packed bytes, whatever archive they are in; a task holds some PIECE bytes, or one piece, at a time.
    ``intact`` tells whether length and checksum are right; a member cut short or not deflated ends there with false.
    """
    scratch = Scratch(found.sparkSession, "members")
    kept = scratch.table("members", found.filter("readable"))
    tasks = (kept.agg(F.sum(F.col("packed") + 4096)).first()[0] or 0) // TASK + 1
    dealt = kept.repartition(tasks, "archive", "number").sortWithinPartitions("archive", "at")
    columns = ["archive", "number", "path", "piece", "content", "intact"]

    def unpacked(f, at: int, packed: int, method: int) -> Iterator[bytes]:
        head = f.read_at(30, at)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            return
        name, extra = struct.unpack("<HH", head[26:30])
        at, end = at + 30 + name + extra, at + 30 + name + extra + packed
        inflate = zlib.decompressobj(-15)
        while at < end:
            block = f.read_at(min(piece, end - at), at)
            if not block:
                return
            at += len(block)
            while method == 8 and block:
                yield inflate.decompress(block, piece)
                block = inflate.unconsumed_tail
            if method == 0:
                yield block

    def pieces(f, r) -> Iterator[tuple]:
        held, place, length, crc = b"", 0, 0, 0
        try:
            for block in unpacked(f, r.at, r.packed, r.method):
                length, crc, held = length + len(block), zlib.crc32(block, crc), held + block
                if len(held) > piece:
                    yield r.archive, r.number, r.path, place, held[:piece], None
                    held, place = held[piece:], place + 1
        except zlib.error:
            crc = -1
        yield r.archive, r.number, r.path, place, held, length == r.length and crc == r.crc

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for part in parts:
            for archive, rows in part.groupby("archive", sort=False):
                store, path = located(archive)
                with store.open_input_file(path) as f:
                    for r in rows.itertuples():
                        for one in pieces(f, r):
                            out.append(one)
                            size += len(one[4])
                            if size >= min(piece, PIECE) or len(out) >= 10_000:
                                yield pd.DataFrame(out, columns=columns)
                                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)

    return dealt.mapInPandas(read, "archive string, number long, path string, piece long, content binary, intact boolean")


def archive_pieces(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Archives of (folder, path, content) in pieces: folder, part, at, bytes. A folder's pieces by (part, at) are its ZIP file.

    Members are deflated in their tasks (part 0); where each starts is a prefix sum over their sizes, cut into slices where a folder
    has many. The directory's entries (part 1) are rows of their own, too, and part 2 ends the file. Members stand in the order of their
    paths' hashes. A member has to fit a task; archives may be of any size (ZIP64). Null contents are empty; rows without a folder
    or path are left out.
    """

    def deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"folder": batch["folder"], "path": batch["path"], "fields": [], "bytes": []}
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name, content = path.as_py().encode(), content.as_py() or b""
                packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
                data = packer.compress(content) + packer.flush()
                # Version 2.0, names in UTF-8, deflate, 1 January 1980; then checksum, both sizes, the name's length, no extra field.
                fields = struct.pack("<HHHHHIIIHH", 20, 0x800, 8, 0, 0x21, zlib.crc32(content), len(data), len(content), len(name), 0)
                out["fields"].append(fields)
                out["bytes"].append(b"PK\x03\x04" + fields + name + data)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("folder", pa.string()), ("path", pa.string()), ("fields", pa.binary()), ("bytes", pa.binary())]))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, fields, at in zip(batch["path"], batch["fields"], batch["at"], strict=True):
                name, extra = path.encode(), struct.pack("<HHQ", 1, 8, at) if at >= WIDE else b""
                head = fields[:-2] + struct.pack("<HHHHII", len(extra), 0, 0, 0, 0, min(at, WIDE))
                out.append(b"PK\x01\x02" + struct.pack("<H", 45 if extra else 20) + head + name + extra)
            yield pd.DataFrame({"folder": batch["folder"], "at": batch["at"], "bytes": out})

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for count, start, size in zip(batch["members"].tolist(), batch["start"].tolist(), batch["size"].tolist(), strict=True):
                wide = b""
                if count >= MANY or start >= WIDE or size >= WIDE:
                    wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start) + b"PK\x06\x07" + struct.pack("<IQI", 0, start + size, 1)
                few = min(count, MANY)
                out.append(wide + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, few, few, min(size, WIDE), min(start, WIDE), 0))
            yield pd.DataFrame({"folder": batch["folder"], "bytes": out})

    spark = files.sparkSession
    scratch = Scratch(spark, "archive")
    rows = files.select(F.col(folder).cast("string").alias("folder"), "path", "content").filter("folder IS NOT NULL AND path IS NOT NULL")
    with arrow_batches(spark, 2 * PIECE):
        packed = rows.mapInArrow(deflated, "folder string, path string, fields binary, bytes binary")
        # Equal paths of a folder are told apart by their bytes, and by a count if these agree.
        stored = scratch.table("packed", packed.withColumn("order", F.xxhash64("path")).withColumn("tie", F.sha2("bytes", 256)))
    sizes = stored.groupBy("folder", "order", "path", "tie").agg(F.count("*").alias("copies"), F.first("fields").alias("fields"), F.first(F.octet_length("bytes")).cast("long").alias("one"))
    placed = scratch.table("placed", scans.scan(sizes.withColumn("all", F.col("one") * F.col("copies")), "folder", ["order", "path", "tie"], start=scans.Total(F.col("all"), own=False)).na.fill(0, ["start"]))
    # A row that occurs several times is written once for each.
    each = placed.select("folder", "path", "fields", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "start", "one").withColumn("at", F.col("start") + F.col("copy") * F.col("one"))
    data = stored.dropDuplicates(["folder", "path", "tie"]).select("folder", "path", "tie", "bytes").join(placed.select("folder", "path", "tie", "copies", "start", "one"), ["folder", "path", "tie"])
    data = data.select("folder", F.lit(0).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "start", "one", "bytes").select("folder", "part", (F.col("start") + F.col("copy") * F.col("one")).alias("at"), "bytes")
    listed = scratch.table("entries", each.select("folder", "path", "fields", "at").mapInPandas(entries, "folder string, at long, bytes binary"))
    start = placed.groupBy("folder").agg(F.sum("all").alias("start"))
    totals = listed.groupBy("folder").agg(F.count("*").alias("members"), F.sum(F.octet_length("bytes")).cast("long").alias("size")).join(start, "folder")
    last = totals.mapInPandas(ends, "folder string, bytes binary").select("folder", F.lit(2).alias("part"), F.lit(0).cast("long").alias("at"), "bytes")
    return data.unionByName(listed.select("folder", F.lit(1).alias("part"), "at", "bytes")).unionByName(last)


def write_archives(files: DataFrame, root: str, folder: str = "folder") -> DataFrame:
    """``<root>/<folder>.zip`` of each folder of (folder, path, content): folder, path, size of what was written.

    One task writes a file, piece by piece as they come from the sort, under another name until it is whole, so that tasks that run
    again leave the same file. Folders' names are percent-encoded.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = located(root)
        store.create_dir(base, recursive=True)
        now, out, size, unfinished = None, None, 0, ""

        def close() -> pd.DataFrame:
            out.close()
            store.move(unfinished, f"{base}/{quote(now, safe='')}.zip")
            return pd.DataFrame([(now, f"{root}/{quote(now, safe='')}.zip", size)], columns=["folder", "path", "size"])

        for part in parts:
            for name, piece in zip(part["folder"], part["bytes"], strict=True):
                if name != now:
                    if out:
                        yield close()
                    now, size, unfinished = name, 0, f"{base}/.{uuid4().hex}"
                    out = store.open_output_stream(unfinished)
                out.write(piece)
                size += len(piece)
        if out:
            yield close()

    pieces = archive_pieces(files, folder)
    spark = files.sparkSession
    with arrow_batches(spark, 2 * PIECE):
        written = pieces.repartition("folder").sortWithinPartitions("folder", "part", "at").mapInPandas(write, "folder string, path string, size long")
        return Scratch(spark, "archives").table("written", written)
