"""Coverage from LCOV text, as one DataFrame plan.

Lines keep their place in the file; records run from ``SF:`` to ``end_of_record``. Functions become intervals (to the line before
the next function; the last to the record's last measured line, or 1000 lines on without any), and lines and branches find their
function by an as-of window, not by comparing all pairs. A repeated ``DA`` counts once with its last value, branches count
each, ``-`` is 0, a repeated ``FN`` takes its last line and hits start again from there. The name of a function is what
follows the first comma.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.functions.text import strip

EXCLUDED = ("test_runner.c", "unity.c")
UNBOUNDED = 1000


def records(raw: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """One row a line inside a record: file, record, seq, kind, fields (after the colon, split at commas), source."""
    lines = raw.select(F.col(file).alias("file"), F.posexplode(F.split(content, "\n")).alias("seq", "line")).withColumn("line", strip(F.col("line")))
    order = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.sum(F.when(F.startswith("line", F.lit("SF:")), 1).otherwise(0)).over(order)
    ended = F.sum(F.when(F.col("line") == "end_of_record", 1).otherwise(0)).over(order)
    marked = lines.withColumns({"record": begun, "ends": ended})
    # Lines after an end and before the next record belong to none.
    within = Window.partitionBy("file", "record")
    marked = marked.withColumn("open", F.col("ends") == F.min("ends").over(within)).filter((F.col("record") > 0) & F.col("open"))
    kind, rest = F.regexp_extract("line", "^([A-Z]+):", 1), F.regexp_replace("line", "^[A-Z]+:", "")
    source = F.max(F.when(F.startswith("line", F.lit("SF:")), F.expr("substr(line, 4)"))).over(within)
    out = marked.select("file", "record", "seq", kind.alias("kind"), F.split(rest, ",").alias("fields"), source.alias("source"))
    for name in EXCLUDED:
        out = out.filter(~F.contains("source", F.lit(name)))
    return out


def _int(i: int) -> Column:
    return F.coalesce(F.get("fields", F.lit(i)).try_cast("int"), F.lit(0))


def measured_lines(rows: DataFrame) -> DataFrame:
    """file, record, source, line, hits."""
    found = rows.filter("kind = 'DA'").select("file", "record", "source", _int(0).alias("line"), _int(1).alias("hits"), "seq")
    return found.groupBy("file", "record", "source", "line").agg(F.max_by("hits", "seq").alias("hits"))


def branches(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'BRDA'").select("file", "record", "source", _int(0).alias("line"), _int(3).alias("hits"))


def functions(rows: DataFrame) -> DataFrame:
    """file, record, source, name, start_line, end_line, hits, rank (first sight)."""
    name = F.get("fields", F.lit(1))
    declared = rows.filter("kind = 'FN'").select("file", "record", "source", name.alias("name"), _int(0).alias("line"), "seq")
    each = declared.groupBy("file", "record", "source", "name").agg(F.max_by("line", "seq").alias("start_line"), F.min("seq").alias("rank"), F.max("seq").alias("last_seq"))
    counted = rows.filter("kind = 'FNDA'").select("file", "record", name.alias("name"), _int(0).alias("n"), "seq")
    hit = each.join(counted, ["file", "record", "name"]).filter("seq > last_seq").groupBy("file", "record", "name").agg(F.max_by("n", "seq").alias("n"))
    last = measured_lines(rows).groupBy("file", "record").agg(F.max("line").alias("last_line"))
    order = Window.partitionBy("file", "record").orderBy("start_line", "rank")
    out = each.join(hit, ["file", "record", "name"], "left").join(last, ["file", "record"], "left")
    end = F.coalesce(F.lead("start_line").over(order) - 1, F.col("last_line"), F.col("start_line") + UNBOUNDED)
    return out.select("file", "record", "source", "name", "start_line", end.alias("end_line"), F.coalesce("n", F.lit(0)).alias("hits"), "rank")


def _counts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(f"{name}_total"), F.count_if(F.col("hits") > 0).alias(f"{name}_covered"))


def _rates(rows: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        rows = rows.withColumn(f"{n}_total", F.coalesce(f"{n}_total", F.lit(0))).withColumn(f"{n}_covered", F.coalesce(f"{n}_covered", F.lit(0)))
        rows = rows.withColumn(f"{n}_rate", numbers.rate(F.col(f"{n}_covered"), F.col(f"{n}_total")))
    return rows


def by_file(rows: DataFrame) -> DataFrame:
    """Lines, functions and branches of each record: total, covered, rate."""
    keys = ["file", "record", "source"]
    out = rows.select(*keys).distinct()
    for part, name in ((measured_lines(rows), "line"), (functions(rows), "function"), (branches(rows), "branch")):
        out = out.join(_counts(part, keys, name), keys, "left")
    return _rates(out, ["line", "function", "branch"])


def by_function(rows: DataFrame) -> DataFrame:
    """Lines and branches of each function's interval: total, covered, rate."""
    keys = ["file", "record", "source"]
    found = functions(rows)
    points = measured_lines(rows).withColumn("what", F.lit("line")).unionByName(branches(rows).withColumn("what", F.lit("branch")))
    place = F.struct("start_line", "rank", "name", "end_line").alias("f")
    starts = found.select(*keys, F.col("start_line").alias("line"), place, F.lit(0).alias("after"))
    both = points.withColumn("after", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    # Of functions that start on one line the last in rank has the interval; the others end before they start.
    order = Window.partitionBy(*keys).orderBy("line", "after", F.col("f.rank")).rowsBetween(Window.unboundedPreceding, 0)
    tagged = both.withColumn("f", F.last("f", ignorenulls=True).over(order)).filter("after = 1 and f is not null and line <= f.end_line")
    tagged = tagged.select(*keys, F.col("f.name").alias("name"), "what", "hits")
    out = found
    for name in ("line", "branch"):
        out = out.join(_counts(tagged.filter(F.col("what") == name), [*keys, "name"], name), [*keys, "name"], "left")
    return _rates(out, ["line", "branch"])


def line_map(rows: DataFrame) -> DataFrame:
    """MAP of line to hits for each record."""
    return measured_lines(rows).groupBy("file", "record", "source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("line", "hits")))).alias("lines"))
