"""Ranges of files, members of archives, archives in pieces."""

import io
import os
import random
import struct
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.plans import catalogue
from millrace.sources import archives, sinks
from millrace.sources import files as archives_in_rows


def test_ranges_read_their_bytes(spark, rows, tmp_path):
    (tmp_path / "sub dir").mkdir()
    data = random.Random(3).randbytes(1000)
    (tmp_path / "sub dir/a b.bin").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"x")
    found = archives.byte_ranges(spark, str(tmp_path), chunk=300).orderBy("path", "offset").collect()
    assert [(os.path.basename(r.path), r.offset, r.limit, r.eof) for r in found] == [("empty", 0, 0, True), ("a b.bin", 0, 300, False), ("a b.bin", 300, 300, False), ("a b.bin", 600, 300, False), ("a b.bin", 900, 100, True)]
    assert b"".join(bytes(r.content) for r in found) == data
    cut = archives.byte_ranges(spark, f"file:{tmp_path}/sub dir/a b.bin", 990, 20).collect()
    assert [(bytes(r.content), r.offset, r.limit, r.eof, r.length) for r in cut] == [(data[990:], 990, 10, True, 1000)]
    beyond = archives.byte_ranges(spark, str(tmp_path), 5000).collect()
    assert [(r.limit, r.eof, bytes(r.content)) for r in beyond] == [(0, True, b"")] * 2
    with pytest.raises(Exception, match="missing"):
        archives.byte_ranges(spark, str(tmp_path / "missing")).collect()


def test_range_of_a_large_file(spark, tmp_path):
    """One range of a sparse file of 200 GB takes moments, its plan in chunks has a task for each 128 MB."""
    with open(tmp_path / "large", "wb") as f:
        f.truncate(200 << 30)
        f.seek(150 << 30)
        f.write(b"needle")
    began = time.time()
    row = archives.byte_ranges(spark, str(tmp_path / "large"), (150 << 30) + 1, 4).first()
    assert bytes(row.content) == b"eedl" and not row.eof and time.time() - began < 20
    reader = archives.ByteRanges({"path": str(tmp_path / "large")}).reader(None)
    assert len(reader.partitions()) == 1600


def packed(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in entries:
            z.writestr(name, content)


def test_members(spark, rows, tmp_path):
    r = random.Random(5)
    long = b"".join(b"%d " % r.randrange(10**6) for _ in range(40_000))
    packed(tmp_path / "one.zip", [("d/", b""), ("d/a.c", b"int a;"), ("long", long), ("../out", b"x"), ("/root", b"x"), ("none", b"")])
    packed(tmp_path / "two.zip", [("plain", long[:5000])], zipfile.ZIP_STORED)
    packed(tmp_path / "odd.zip", [("bz", b"abc")], zipfile.ZIP_BZIP2)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    packed(tmp_path / "hurt.zip", [("h", long)])
    whole = bytearray((tmp_path / "hurt.zip").read_bytes())
    whole[2000:2040] = bytes(40)
    (tmp_path / "hurt.zip").write_bytes(whole)
    paths = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    found = archives.members(paths)
    base = F.regexp_extract("archive", "[^/]+$", 0)
    assert rows(found.select(base, "path", "length", "readable")) == sorted([("one.zip", "d/a.c", 6, True), ("one.zip", "long", len(long), True), ("one.zip", "none", 0, True), ("two.zip", "plain", 5000, True), ("odd.zip", "bz", 3, False), ("hurt.zip", "h", len(long), True)], key=repr)
    pieces = archives.contents(found, 10_000).withColumn("archive", base).orderBy("archive", "number", "piece").collect()
    assert max(len(p.content) for p in pieces) <= 10_000
    joined = {}
    for p in pieces:
        joined[p.archive, p.path] = joined.get((p.archive, p.path), b"") + bytes(p.content)
    assert joined["one.zip", "long"] == long and joined["one.zip", "d/a.c"] == b"int a;" and joined["one.zip", "none"] == b"" and joined["two.zip", "plain"] == long[:5000]
    assert {(p.archive, p.path): p.intact for p in pieces if p.intact is not None} == {("one.zip", "long"): True, ("one.zip", "d/a.c"): True, ("one.zip", "none"): True, ("two.zip", "plain"): True, ("hurt.zip", "h"): False}
    assert archives.contents(archives.members(paths.limit(0))).count() == 0


def test_written_archives(spark, rows, tmp_path):
    data = [("a", f"p/é{i}.c", bytearray(b"x%d" % i * i)) for i in range(300)] + [("b/c", "one", bytearray(b"1")), ("b/c", "one", bytearray(b"1")), ("b/c", "one", bytearray(b"2")), ("b/c", "null", None), (None, "x", None), ("a", None, None)]
    files = spark.createDataFrame(data, "folder string, path string, content binary").repartition(5)
    made = archives.write_archives(files, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a.zip", "b%2Fc.zip"] and rows(made.select("folder")) == [("a",), ("b/c",)]
    assert {r.path: r["size"] for r in made.collect()} == {str(tmp_path / "out" / n): (tmp_path / "out" / n).stat().st_size for n in ("a.zip", "b%2Fc.zip")}
    with zipfile.ZipFile(tmp_path / "out/a.zip") as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {p: bytes(c) for f, p, c in data if f == "a" and p}
    with zipfile.ZipFile(tmp_path / "out/b%2Fc.zip") as z:
        assert z.testzip() is None and sorted((i.filename, z.read(i)) for i in z.infolist()) == [("null", b""), ("one", b"1"), ("one", b"1"), ("one", b"2")]
    read = archives.contents(archives.members(made.select("path")))
    assert read.count() == 304 and read.filter("intact").count() == 304
    assert archives.write_archives(files.limit(0), str(tmp_path / "none")).count() == 0


def test_many_members_in_slices(spark, tmp_path, monkeypatch):
    """More members than two bytes can count, in several slices of one folder."""
    monkeypatch.setattr(archives.scans, "LIMIT", 20_000)
    files = spark.range(70_000).select(F.lit("f").alias("folder"), F.concat(F.lit("n"), "id").alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    pieces = archives.archive_pieces(files)
    whole = b"".join(bytes(r.bytes) for r in pieces.orderBy("part", "at").collect())
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        assert len(z.namelist()) == 70_000 and z.read("n69999") == b"69999" and z.read("n0") == b"0"
    assert struct.unpack("<H", whole[-14:-12])[0] == 0xFFFF


def test_written_files(spark, tmp_path):
    files = spark.createDataFrame([("a.zip", bytearray(b"none")), ("b.txt", bytearray(b""))], "name string, content binary")
    made = sinks.write_files(files, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a.zip", "b.txt"] and (tmp_path / "out/a.zip").read_bytes() == b"none"
    assert {r.path: r.length for r in made.collect()} == {str(tmp_path / "out/a.zip"): 4, str(tmp_path / "out/b.txt"): 0} and archives.members(made).count() == 0


def test_archive_queries_hold_no_archive_whole(spark, monkeypatch):
    """Archives of the queries are written and read member by member."""

    def whole(*_):
        raise AssertionError("an archive is packed or read whole")

    monkeypatch.setattr(sinks, "zipped", whole)
    monkeypatch.setattr(archives_in_rows, "zip_entries", whole)
    found = catalogue.queries()["zip_roundtrip"](spark, "/root/testdata/sf0.001")
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    assert sorted(r.content for r in found.collect()) == sorted(r.c_name for r in customers.collect())
    assert catalogue.queries()["zip_code_counts"](spark, "/root/testdata/sf0.001").agg(F.sum("files")).first()[0] == customers.count()
