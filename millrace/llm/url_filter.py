"""URL filter: listed rules first, then gradient-boosted trees on lexical features.

Urls that a rule decides are the labelled ones. The trees learn from about ``MAX_SAMPLE`` different ones, half of either verdict, chosen by
a hash and weighted back to their shares, on length, depth, digit share, character entropy, parameter counts and statistics of the
host's suffix: the share of blocked urls and how common it is, counted over all labelled urls. Suffixes with less than one in
``SUFFIXES`` of the labelled urls share the overall figures, so the table of suffixes has at most that many rows and is broadcast.
All steps are DataFrame functions and Spark's own tree learner.

Defined results: null or a url without ``://`` has empty host and path and is judged like any other; without labelled urls
everything unruled is allowed, with labels of one kind that kind is the verdict; repeated rows are judged alike; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import Scratch

#: Verdict, host and path of each rule.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MAX_SAMPLE, SUFFIXES = 20_000, 1000
TREES, DEPTH = 12, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_values", "f_labels", "f_hyphens", "f_host", "f_suffix_rate", "f_suffix_share"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), UPPER, LOWER), F.regexp_extract(text, _PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for what, at, begins in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(begins)
        rule, verdict = F.when(fits, F.lit(at + begins)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame, url_col: str) -> DataFrame:
    """``urls`` (with host and path) with the lexical features and the host's suffix."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    count = lambda c, what: F.char_length(c) - F.char_length(F.replace(c, F.lit(what), F.lit("")))
    share = lambda ch: (n - F.char_length(F.replace(url, ch, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda total, ch: total - F.when(share(ch) > 0, share(ch) * F.log2(F.greatest(share(ch), F.lit(1e-9)))).otherwise(0.0))
    return urls.withColumns(
        {
            "f_length": n.cast("double"),
            "f_depth": count(F.col("path"), "/").cast("double"),
            "f_digits": F.regexp_count(url, F.lit("[0-9]")) / n,
            "f_entropy": entropy,
            "f_params": F.when(query == "", 0).otherwise(count(query, "&") + 1).cast("double"),
            "f_values": count(query, "=").cast("double"),
            "f_labels": (count(F.col("host"), ".") + 1).cast("double"),
            "f_hyphens": count(F.col("host"), "-").cast("double"),
            "f_host": F.char_length("host").cast("double"),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


@dataclass
class Model:
    trees: GBTClassificationModel
    suffixes: DataFrame
    overall: float

    def probability(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p_block``."""
        found = _with_suffix(rows, self.suffixes, self.overall)
        out = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
        return out.select(*rows.columns, vector_to_array("probability")[1].alias("p_block"))


def _with_suffix(rows: DataFrame, suffixes: DataFrame, overall: float) -> DataFrame:
    found = rows.join(F.broadcast(suffixes), "suffix", "left")
    return found.withColumns({"f_suffix_rate": F.coalesce("suffix_rate", F.lit(overall)), "f_suffix_share": F.coalesce("suffix_share", F.lit(0.0))}).drop("suffix_rate", "suffix_share")


def train(rows: DataFrame, scratch: Scratch, max_sample: int = MAX_SAMPLE) -> Model | str:
    """A model from the rows that have a verdict; or the one verdict that they, or their absence, allow."""
    labelled = rows.filter(F.col("rule_verdict").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy("rule_verdict").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), "allow")
    total, overall = sum(counts.values()), counts["block"] / sum(counts.values())
    block = (F.col("rule_verdict") == "block").cast("double")
    grouped = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum(block).alias("blocked")).filter(F.col("n") * SUFFIXES >= total)
    suffixes = scratch.table(
        "suffixes",
        grouped.select("suffix", ((F.col("blocked") + 10 * overall) / (F.col("n") + 10)).alias("suffix_rate"), (F.col("n") / total).alias("suffix_share")).coalesce(1),
    )
    rates = {v: min(1.0, max_sample / 2 / n) for v, n in counts.items()}
    rate = F.when(F.col("rule_verdict") == "block", F.lit(rates["block"])).otherwise(F.lit(rates["allow"]))
    chosen = labelled.filter(F.pmod(F.xxhash64(F.lit(41), "page_url"), F.lit(1 << 40)) < rate * (1 << 40)).dropDuplicates(["page_url"])
    wanted = chosen.select("suffix", *[c for c in rows.columns if c.startswith("f_")], block.alias("label"), (1 / rate).alias("weight"))
    sample = scratch.table("sample", wanted.repartition(4))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_with_suffix(sample, suffixes, overall)).select("features", "label", "weight")
    return Model(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=3, weightCol="weight").fit(ready), suffixes, overall)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, url, ``host``, ``path``, ``rule``, ``verdict`` and ``p_block`` (null where a rule decides) of every row of ``pages``."""
    host, path = split_url(F.col("page_url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_key"), F.col(url_col).alias("page_url")).withColumns({"host": host, "path": path})
    rows = lexical(rows.withColumns({"rule": rule, "rule_verdict": verdict}), "page_url")
    model = train(rows, Scratch(pages.sparkSession, "url-filter"))
    scored = model.probability(rows) if isinstance(model, Model) else rows.withColumn("p_block", F.lit(1.0 if model == "block" else 0.0))
    ruled = F.col("rule_verdict").isNotNull()
    return scored.select(
        F.col("page_key").alias(id_col),
        F.col("page_url").alias(url_col),
        "host",
        "path",
        "rule",
        F.when(ruled, F.col("rule_verdict")).when(F.col("p_block") > 0.5, "block").otherwise("allow").alias("verdict"),
        F.when(~ruled, F.col("p_block")).alias("p_block"),
    )


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")
