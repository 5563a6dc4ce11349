"""Structured Streaming twins, fed from files."""

import random
import time

from millrace.streaming import replay


def test_lines_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    schema = "stream_id string, seq int, chunk string"
    out = str(tmp_path / "out")
    for k, rows in enumerate([[("s", 0, "a\nb"), ("t", 0, "x")], [("s", 1, "c\nd"), ("t", 1, "y\n")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = replay.lines(spark.readStream.schema(schema).parquet(str(source)))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((r.stream_id, r.line) for r in spark.read.parquet(out).collect()) == [("s", "a"), ("s", "bc"), ("t", "xy")]


def test_windows_over_events(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'error' AS event_type, 1L AS user_id UNION ALL SELECT timestamp'2024-01-01 10:05:00', 'error', 1L UNION ALL SELECT timestamp'2024-01-03 10:00:00', 'view', 1L")
    rows.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    kept = []
    replay.run_to_end(replay.windowed_counts(stream).select("event_type", "n"), lambda batch, _: kept.extend(tuple(r) for r in batch.collect()), str(tmp_path / "c1"))
    assert ("error", 2) in kept
    kept.clear()
    replay.run_to_end(replay.sessions(stream, "user_id").select("n"), lambda batch, _: kept.extend(tuple(r) for r in batch.collect()), str(tmp_path / "c2"))
    assert (2,) in kept


CHUNKS = "stream_id string, seq int, chunk string"


def test_shuffled_chunks_over_batches(spark, tmp_path):
    """Chunks in any order over batches, some twice, give each stream's lines in order, without the unfinished one."""
    rng, source, out = random.Random(3), tmp_path / "in", str(tmp_path / "out")
    texts = {f"s{k}": "\n".join(f'{{"n": {i}}}' if i % 5 else "{broken" for i in range(20)) + ("\n" if k % 2 else "\n{\"n\": 99}") for k in range(6)}
    rows = []
    for name, text in texts.items():
        cut = [text[i : i + 7] for i in range(0, len(text), 7)]
        rows += [(name, i, c) for i, c in enumerate(cut)]
    rng.shuffle(rows)
    rows += rows[:10] + [(None, 0, "x\n"), ("s0", None, "y")]
    for k in range(3):
        spark.createDataFrame(rows[k::3], CHUNKS).coalesce(1).write.mode("append").parquet(str(source))
        query = replay.framed(spark.readStream.schema(CHUNKS).parquet(str(source)), idle=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    found = spark.read.schema(replay.LINES).parquet(out)
    for name, text in texts.items():
        lines = [r.line for r in found.filter(f"stream_id = '{name}'").orderBy("place").collect()]
        assert lines == text.split("\n")[:-1]
    objects = replay.json_frames(found, "n int").filter("stream_id = 's0'").orderBy("place").collect()
    assert [r.n for r in objects] == [i for i in range(20) if i % 5]


def test_an_idle_stream_ends(spark, tmp_path):
    """After a gap that never closes only whole lines come out, the open tail goes, and the stream can start again."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    write = lambda rows: spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(str(source))
    write([("s", 0, "a\nopen"), ("s", 2, "rest\nb\nc"), ("s", 3, "d\ne"), ("s", 7, "f\ng\nh")])
    stream = replay.framed(spark.readStream.schema(CHUNKS).parquet(str(source)), idle=2000)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    got = lambda: sorted((r.place, r.line) for r in spark.read.schema(replay.LINES).parquet(out).collect())
    try:
        for wanted, more in ([(0, "a"), (1, "b"), (2, "cd"), (3, "g")], [("s", 0, "again\n")]), ([(0, "a"), (0, "again"), (1, "b"), (2, "cd"), (3, "g")], None):
            until = time.time() + 40
            while time.time() < until and (not (tmp_path / "out" / "_spark_metadata").exists() or got() != wanted):
                time.sleep(0.5)
            assert got() == wanted
            if more:
                write(more)
    finally:
        query.stop()
