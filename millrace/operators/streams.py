"""Ordered chunks of text: reassembly, line framing, event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip


def reassemble(chunks: DataFrame, stream: str, seq: str, chunk: str, name: str = "content") -> DataFrame:
    """One text a stream: its chunks in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(chunk).alias("c"))))
    return chunks.groupBy(stream).agg(parts.alias("_parts")).select(stream, F.array_join(F.transform("_parts", lambda p: p["c"]), "").alias(name))


def ndjson(chunks: DataFrame, stream: str, seq: str, chunk: str, schema: str, unfinished: bool = True) -> DataFrame:
    """The objects of each stream of newline-framed JSON, however chunks cut it; blank and broken lines are skipped.

    ``unfinished``: whether text behind the last line end counts as a line; a reader of a stream that may still go on drops it.
    """
    whole = reassemble(chunks, stream, seq, chunk)
    if not unfinished:
        whole = whole.withColumn("content", F.regexp_extract("content", r"(?s)^(.*)\n", 1))
    lines = whole.select(stream, F.posexplode(F.split("content", "\n")).alias("place", "line")).filter(strip(F.col("line")) != "")
    parsed = lines.withColumn("frame", F.when(F.try_parse_json("line").isNotNull(), F.from_json("line", schema)))
    return parsed.filter(F.col("frame").isNotNull()).select(stream, "place", "frame.*")


def sse(lines: DataFrame, stream: str, seq: str, line: str) -> DataFrame:
    """The payloads of ``data:`` lines before a stream's end mark; broken JSON is skipped."""
    data = lines.filter(F.startswith(line, F.lit("data: "))).withColumn("payload", strip(F.expr(f"substr({line}, 7)")))
    end = data.filter("payload = '[DONE]'").groupBy(stream).agg(F.min(seq).alias("_end"))
    kept = data.join(end, stream, "left").filter(F.col("_end").isNull() | (F.col(seq) < F.col("_end")))
    return kept.filter(F.try_parse_json("payload").isNotNull()).select(stream, seq, "payload")


def newest_response(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of several responses for a key the one with the largest number; staler ones go."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")
