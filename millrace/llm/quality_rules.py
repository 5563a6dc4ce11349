"""Quality rules: fixed base rules, then robust multivariate outliers by a minimum-covariance-determinant estimate.

Each text gives counts (words, symbols, repeated lines, words in repeated three-word windows). Texts that pass the base rules
are described by four transformed statistics; for every (language, source) group a location and scatter come from the
regularised MCD. Three deterministic starts (medians with MADs alone, with the correlations of the standardised statistics'
hyperbolic tangents, and with those of their spatial signs) each go through concentration steps, which keep the half of the texts
nearest under the current estimate, until none moves; the one with the least determinant is kept, and the last estimate is made
of all texts that lie near that one. So up to half of a group may be junk, copies of one page included, without moving its
estimate to it. Groups with fewer than ``MIN_GROUP`` texts use their language's estimate, and that the whole table's, if it is
large enough; else nothing is rejected. A text is rejected when its squared Mahalanobis distance exceeds the cutoff.

All of it is DataFrame functions: repeated windows come from one sorted array a text, moments from partial aggregates, the
4 x 4 Cholesky factor from column arithmetic on the small table of estimates. Groups that hold a ``1 / HOT`` of all texts or more
(the whole table among them; 3 x HOT at most) get their estimates by broadcast, so that no task gathers one of them; the others
are dealt by group.

Defined results: a null text has no words and fails the base rules; null and empty language (or source) are one group;
repeated rows are judged alike, each for itself; an empty table gives an empty result; further columns of the input are not
read by ``measure`` and are kept by ``quality_stage``.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.session import Scratch

SPACE = " \t\n\u000b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The share of a group that the estimate rests on, and the smallest group with an estimate of its own.
SHARE, MIN_GROUP = 0.5, 50
#: Groups with at least one in so many of the texts are hot.
HOT = 1000
#: Steps end when no estimate moves by more than this share of the least deviations; more than MOST_STEPS are warned of.
STILL, MOST_STEPS = 1e-3, 50
#: The share of normal texts that the last, reweighted estimate is made of.
NEAR = 0.975
#: The least standard deviation of each statistic: a share of the texts may agree exactly, others may differ a little.
STATISTICS = {"x_length": 0.06, "x_symbols": 0.35, "x_lines": 0.12, "x_repeats": 0.12}
#: Chance that a normal text lies beyond the cutoff.
TAIL = 1e-9


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; each word counts once.

    The windows' hashes, each with its position, are sorted; equal neighbours whose words agree are repeats.
    """

    def windows(w: Column) -> Column:
        placed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))
        return let(F.sort_array(placed), lambda s: repeats(w, s))

    def repeats(w: Column, s: Column) -> Column:
        at = lambda k: F.get(s, k)["at"]

        def same(k: Column) -> Column:
            equal = [F.get(w, at(k) + j) == F.get(w, at(k - 1) + j) for j in range(3)]
            return F.when(F.get(s, k)["h"] == F.get(s, k - 1)["h"], equal[0] & equal[1] & equal[2]).otherwise(F.lit(False))

        found = F.when(F.size(s) > 1, F.filter(F.sequence(F.lit(1), F.size(s) - 1), same)).otherwise(F.array().cast("array<int>"))
        places = F.sort_array(F.array_distinct(F.flatten(F.transform(found, lambda k: F.array(at(k - 1), at(k))))))
        return let(places, covered)

    def covered(p: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(p) - 1)
        grown = F.aggregate(steps, F.lit(3), lambda total, j: total + F.least(F.lit(3), F.get(p, j) - F.get(p, j - 1)))
        return F.when(F.size(p) == 0, F.lit(0)).when(F.size(p) == 1, F.lit(3)).otherwise(grown)

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, windows)).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and the four statistics; the text column itself goes."""
    text = F.coalesce(text_col, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups")))
    found = docs.select(
        *[c for c in docs.columns if c != text_col],
        counts.alias("_counts"),
        line_counts.alias("_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n, chars, repeats, dups = F.col("_counts.n_words"), F.col("_counts.word_chars"), F.col("_counts.n_repeat_words"), F.col("_lines.dups")
    return found.select(
        *[c for c in docs.columns if c != text_col],
        n.alias("n_words"),
        chars.alias("word_chars"),
        "n_symbols",
        dups.alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
        F.log(F.greatest(chars, F.lit(1)) / F.greatest(n, F.lit(1))).alias("x_length"),
        F.log1p(100 * F.col("n_symbols") / F.greatest(chars, F.lit(1))).alias("x_symbols"),
        F.sqrt(dups / F.greatest(F.col("_lines.lines"), F.lit(1))).alias("x_lines"),
        F.sqrt(repeats / F.greatest(n, F.lit(1))).alias("x_repeats"),
    )


def _cdf(x: float, degrees: int) -> float:
    """The chi-squared distribution function for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def _quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        low, high = ((low + high) / 2, high) if _cdf((low + high) / 2, degrees) < p else (low, (low + high) / 2)
    return low


def _distance(x: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the columns m_i and l_ij of an estimate."""
    solved: list[Column] = []
    for i, name in enumerate(x):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l_{i}{i}"))
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


_KEYS = ["level", "key", "start"]


def _factor(moments: DataFrame, floors: list[float], scale: float) -> DataFrame:
    """The estimates with their Cholesky factor: covariance times ``scale`` plus the squared floors on the diagonal."""
    d = len(floors)
    out = moments
    for i in range(d):
        for j in range(i + 1):
            part = F.col(f"c_{i}{j}") * scale + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                part = part - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(part, F.lit(floors[i] ** 2 * 1e-3))) if i == j else part / F.col(f"l_{j}{j}"))
    return out.select(*_KEYS, "n", *[f"m_{i}" for i in range(d)], *[f"l_{i}{j}" for i in range(d) for j in range(i + 1)])


def _moved(old: DataFrame, new: DataFrame, floors: list[float]) -> float:
    """How far the estimates differ at most, in least deviations; 0 if there are none."""
    params = [(c, floors[int(c[2])]) for c in new.columns if c[:2] in ("m_", "l_")]
    before = old.select(*_KEYS, *[F.col(c).alias(f"_{c}") for c, _ in params])
    apart = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) / floor for c, floor in params])
    return new.join(before, _KEYS).agg(F.max(apart)).first()[0] or 0.0


def _starts(attach, middle: DataFrame, floors: list[float], scratch: Scratch) -> DataFrame:
    """Three estimates for each group: medians with deviations from MADs, and correlations of three kinds."""
    x, d = list(STATISTICS), len(floors)
    cells = [(i, j) for i in range(d) for j in range(i + 1)]
    off = [F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{i}")), 0.5).alias(f"s_{i}") for i, c in enumerate(x)]
    spread = attach(middle).groupBy("level", "key").agg(*off)
    scaled = [F.sqrt((1.4826 * F.col(f"s_{i}")) ** 2 + floors[i] ** 2).alias(f"s_{i}") for i in range(d)]
    scales = scratch.table("scales", middle.join(spread, ["level", "key"]).select("level", "key", "n", *[f"m_{i}" for i in range(d)], *scaled))
    z = [(F.col(c) - F.col(f"m_{i}")) / F.col(f"s_{i}") for i, c in enumerate(x)]
    length = F.greatest(F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0])), F.lit(1e-9))
    kinds = {1: [F.tanh(v) for v in z], 2: [v / length for v in z]}
    products = attach(scales).groupBy("level", "key").agg(*[F.avg(v[i] * v[j]).alias(f"p{k}_{i}{j}") for k, v in kinds.items() for i, j in cells])
    both = scratch.table("products", scales.join(products, ["level", "key"]))
    out = None
    for k in (0, 1, 2):

        def cell(i: int, j: int, k: int = k) -> Column:
            own = F.col(f"s_{i}") * F.col(f"s_{j}")
            if i == j or not k:
                return own if i == j else F.lit(0.0)
            norm = F.sqrt(F.col(f"p{k}_{i}{i}") * F.col(f"p{k}_{j}{j}"))
            return own * F.when(norm > 0, F.col(f"p{k}_{i}{j}") / norm).otherwise(0.0)

        one = both.select("level", "key", F.lit(k).alias("start"), "n", *[f"m_{i}" for i in range(d)], *[cell(i, j).alias(f"c_{i}{j}") for i, j in cells])
        out = one if out is None else out.unionByName(one)
    return scratch.table("start", _factor(out, floors, 1.0))


def fit(measured: DataFrame, scratch: Scratch, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Regularised MCD estimates: one row for each group, language and the whole, with at least MIN_GROUP texts."""
    x, floors = list(STATISTICS), list(STATISTICS.values())
    lang, source = F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.to_json(F.array(lang, source)).alias("key")),
        F.struct(F.lit(1).alias("level"), F.to_json(F.array(lang)).alias("key")),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("key")),
    )
    rows = measured.filter(~F.col("base_failed")).select(F.explode(levels).alias("g"), *x).select("g.level", "g.key", *x)
    middle = rows.groupBy("level", "key").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5).alias(f"m_{i}") for i, c in enumerate(x)])
    middle = scratch.table("medians", middle.filter(F.col("n") >= MIN_GROUP))
    total = (middle.filter("level = 2").agg(F.sum("n")).first()[0] or 0) if not middle.isEmpty() else 0
    hot = F.col("n") * HOT >= total
    some_cold = not middle.filter(~hot).isEmpty()

    def attach(small: DataFrame) -> DataFrame:
        """``rows`` with the columns of their groups in ``small``; at most HOT groups of a level are hot."""
        found = rows.join(F.broadcast(small.filter(hot)), ["level", "key"])
        if not some_cold:
            return found
        rest = rows.join(F.broadcast(middle.filter(hot).select("level", "key")), ["level", "key"], "left_anti")
        return found.unionByName(rest.join(small.filter(~hot), ["level", "key"]))

    def refit(name: str, limits: DataFrame, share: float) -> DataFrame:
        near = attach(limits).filter(_distance(x) <= F.col("cut")).select(*_KEYS, "n", *x)
        moments = near.groupBy(*_KEYS).agg(
            F.first("n").alias("n"),
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(x)],
            *[F.covar_pop(x[i], x[j]).alias(f"c_{i}{j}") for i in range(len(x)) for j in range(i + 1)],
        )
        return scratch.table(name, _factor(moments, floors, share / _cdf(_quantile(share, len(x)), len(x) + 2)))

    estimate = _starts(attach, middle, floors, scratch)
    for step in range(MOST_STEPS):
        far = attach(estimate).select(*_KEYS, _distance(x).alias("d2"))
        cut = far.groupBy(*_KEYS).agg(F.percentile_approx("d2", SHARE).alias("cut"))
        # A table again: its few rows, not those of a hot group, are what the next join moves.
        limits = scratch.table(f"cut{step}", estimate.join(cut, _KEYS))
        last, estimate = estimate, refit(f"step{step}", limits, SHARE)
        if _moved(last, estimate, floors) <= STILL:
            break
    else:
        warnings.warn(f"robust estimates still move after {MOST_STEPS} steps", stacklevel=2)
    # The determinant is the squared product of the factor's diagonal.
    size = sum((F.log(f"l_{i}{i}") for i in range(1, len(x))), F.log("l_00"))
    names = [c for c in estimate.columns if c not in ("level", "key")]
    least = scratch.table("least", estimate.groupBy("level", "key").agg(F.min_by(F.struct(*names), F.struct(size, "start")).alias("e")).select("level", "key", "e.*"))
    return refit("reweighted", least.withColumn("cut", F.lit(_quantile(NEAR, len(x)))), NEAR)


def judge(measured: DataFrame, estimates: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``measured`` with ``distance2`` (null: no estimate or base failed) and ``kept``."""
    x = list(STATISTICS)
    params = [c for c in estimates.columns if c[:2] in ("m_", "l_")]
    lang, source = F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    out = measured
    for level, key in enumerate([F.to_json(F.array(lang, source)), F.to_json(F.array(lang))]):
        one = estimates.filter(F.col("level") == level).select(F.col("key").alias("_key"), F.struct(*params).alias(f"_e{level}"))
        out = out.withColumn("_key", key).join(one, "_key", "left").drop("_key")
    whole = estimates.filter("level = 2").select(*params).first()  # one row, or none
    kind = "struct<" + ",".join(f"{c}:double" for c in params) + ">"
    out = out.withColumn("_e2", F.struct(*[F.lit(float(whole[c])).alias(c) for c in params]) if whole else F.lit(None).cast(kind))
    out = out.withColumn("_e", F.coalesce("_e0", "_e1", "_e2")).drop("_e0", "_e1", "_e2")
    names = measured.columns
    out = out.select(*names, *[F.col(f"_e.{c}").alias(c) for c in params])
    out = out.select(*names, F.when(~F.col("base_failed"), _distance(x)).alias("distance2"))
    cutoff = _quantile(1 - TAIL, len(x))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` (id, text, lang, source) judged: base counts, ``base_failed``, ``distance2`` and ``kept``."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    measured = scratch.table("measured", measure(docs.select(id_col, "text", "lang", "source")))
    return judge(measured, fit(measured, scratch))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``.

    Each text is measured once: its row goes to the table of measures with it. The estimates read only the table's other columns,
    and the filter ends at the table instead of measuring the texts again.
    """
    scratch = Scratch(spark, "quality-stage")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source")
    measured = scratch.table("measured", measure(rows))
    return judge(measured, fit(measured.drop("_row"), scratch)).filter("kept").select("_row.*")
