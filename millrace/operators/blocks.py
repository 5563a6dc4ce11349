"""Blocks of lines between braces, chosen from left to right, without a task that walks a whole text.

A start's block ends on the first line from its opening brace on after which no more braces are open than before it. Each line at which
the balance falls is listed under the levels that it falls through, so the end is the next line in the list of the start's level. A block
consumes its lines, starts inside it don't count. A start that no earlier start's block reaches is chosen in any case; from each start the next one behind
its block is known, and doubling these steps finds all that are reached from chosen ones in as many rounds as the logarithm of the longest chain.

Texts of any number of lines are spread over tasks (see ``scans``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.scans import Greatest, Latest, Next, Slices, Total, scan
from millrace.session import Scratch

#: The end of a block that never closes.
OPEN = 2**31 - 1


class Lines:
    """The lines of texts as a stored table: key, at (from 0), line, and ``more`` columns; ``total`` and ``before``, the balance of braces after and before each line."""

    def __init__(self, code: DataFrame, key: str, content: str, limit: int | None = None, **more: Column):
        self.key, self.scratch = key, Scratch(code.sparkSession, "lines")
        rows = code.select(key, F.posexplode(F.split(content, "\n")).alias("at", "line"))
        count = lambda brace: F.length("line") - F.length(F.replace(F.col("line"), F.lit(brace), F.lit("")))
        split = self.scratch.table("split", rows.withColumns({**more, "change": count("{") - count("}"), "opens": F.contains("line", F.lit("{"))}))
        self.slices = Slices(split, key, "at", limit)
        self.rows = self.scratch.table("balanced", scan(split, key, ["at"], self.slices, total=Total(F.col("change"))).withColumn("before", F.col("total") - F.col("change")))

    def following(self, rows: DataFrame, own: Column, **found: Column) -> DataFrame:
        """``rows`` with, for each wanted name, its value on the next line where it isn't null; on this line, where ``own`` holds."""
        found_ = scan(rows, self.key, ["at"], self.slices, **{f"_{n}": Next(c) for n, c in found.items()})
        return found_.select(*rows.columns, *[F.when(own, c).otherwise(F.col(f"_{n}")).alias(n) for n, c in found.items()])

    def ended(self, starts: DataFrame) -> DataFrame:
        """``starts`` (key, at, level, opened, reached, and others) with ``end``: the first line from ``opened`` on, where the balance is ``reached``, with a balance of ``level`` at most; null if none."""
        falls = self.rows.filter("total < before").select(self.key, F.explode(F.sequence(F.col("total"), F.col("before") - 1)).alias("level"), "at", F.lit(0).alias("asks"))
        asks = starts.withColumn("start", F.col("at")).withColumn("at", F.col("opened")).withColumn("asks", F.lit(1))
        found = scan(falls.unionByName(asks, allowMissingColumns=True), [self.key, "level"], ["at", "asks"], self.slices, _close=Next(F.when(F.col("asks") == 0, F.col("at")))).filter("asks = 1")
        end = F.when(F.col("reached") <= F.col("level"), F.col("opened")).otherwise(F.col("_close"))
        return found.withColumn("end", end).withColumn("at", F.col("start")).select(*starts.columns, "end")

    def chosen(self, starts: DataFrame) -> DataFrame:
        """Of ``starts`` (key, at, end, and others) those that a walk from the first line meets that goes on behind each block."""
        key = self.key
        first = scan(starts, key, ["at"], self.slices, _reach=Greatest(F.col("end"), own=False)).withColumn("taken", F.coalesce(F.col("_reach") < F.col("at"), F.lit(True))).drop("_reach")
        every = self.scratch.table("starts", first)
        if every.filter("NOT taken").isEmpty():
            return every.drop("taken")
        asks = every.select(key, F.col("at").alias("start"), F.col("end").alias("at"), "taken", F.lit(1).alias("asks"))
        both = every.select(key, "at", F.lit(0).alias("asks")).unionByName(asks, allowMissingColumns=True)
        steps = scan(both, key, ["at", "asks"], self.slices, jump=Next(F.when(F.col("asks") == 0, F.col("at")))).filter("asks = 1")
        steps = self.scratch.table("steps-0", steps.select(key, F.col("start").alias("at"), "jump", "taken", F.lit(False).alias("fresh")))
        turn = 0
        while True:
            hit = steps.filter("taken AND jump IS NOT NULL").select(key, F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
            twice = steps.select(key, F.col("at").alias("jump"), F.col("jump").alias("twice"))
            found, known = F.coalesce("hit", F.lit(False)), F.col("taken")
            stepped = steps.join(hit, [key, "at"], "left").join(twice, [key, "jump"], "left")
            turn += 1
            steps = self.scratch.table(f"steps-{turn}", stepped.select(key, "at", F.col("twice").alias("jump"), (known | found).alias("taken"), (found & ~known).alias("fresh")))
            self.scratch.drop(f"steps-{turn - 1}")
            if steps.filter("fresh").isEmpty():
                return every.drop("taken").join(steps.filter("taken").select(key, "at"), [key, "at"])

    def inside(self, blocks: DataFrame) -> DataFrame:
        """The lines with ``inside``: whether one of the blocks (key, at, end, none of which overlap) holds it."""
        marked = self.rows.join(blocks.select(self.key, "at", F.col("end").alias("_end")), [self.key, "at"], "left")
        found = scan(marked, self.key, ["at"], self.slices, _until=Latest(F.col("_end")))
        return found.withColumn("inside", F.coalesce(F.col("_until") >= F.col("at"), F.lit(False))).drop("_end", "_until")
