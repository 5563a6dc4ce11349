"""Source divergence audit: how far the term frequencies of a language's sources lie from each other and from the language's.

Terms are counted in tasks over exact integer codes and dealt by language and term. The kept terms of each language get ids in
UTF-8 order (one range sort, stored) without gaps, and successive ids are chunks of bounded size. In a chunk every row's place comes from the
sorted array of its kept terms, ``bincount`` makes one dense vector a source, and the chunk gives a part of each pair's
sum and its own first terms for each source; only these small rows are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.session import Scratch

#: A kept term occurs in as many documents of its language at least; what each count is raised by; what a frequency of one is.
MIN_DOCS, PRIOR, SCALE = 30, 5, 1_000_000_000
#: Ranks of terms that are reported.
TOP = 50
#: Dense cells of a chunk: its terms times the sources of its language. Terms of a chunk at most.
CELLS, CHUNK = 1 << 22, 4096
#: Counted rows that a task keeps before it hands them on, and bytes of text that it counts at once.
ROWS, STEP = 1 << 20, 4 << 20

BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

COUNTS = "lang string, source string, term string, n long, df long"
PARTS = "lang string, source string, part string, item string, value long, id long"

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(df) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN k USING (lang, term)),
dense AS (SELECT g.lang, g.source, k.term, coalesce(kept.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN kept ON kept.lang = g.lang AND kept.source = g.source AND kept.term = k.term),
p AS (SELECT lang, source, term, dense.n, 1 + (1000000000 * (dense.n + 5)) // (sum(dense.n) OVER (PARTITION BY lang, source) + 5 * v.v) AS p FROM dense JOIN v USING (lang)),
l AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v.v)) AS q FROM dense JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - l.q AS value FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM terms) WHERE rank <= 50
"""


def _grouped(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, how often each occurs, and the sums of ``n`` (by default of ones)."""
    if not len(keys):
        return keys, keys, keys
    if n is None:
        keys = np.sort(keys)
    else:
        by = np.argsort(keys, kind="stable")
        keys, n = keys[by], n[by]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(heads, append=len(keys))
    return keys[heads], count, count if n is None else np.add.reduceat(n, heads)


def _counted(text: pa.Array, lang: pa.Array, source: pa.Array) -> Iterator[pa.Table]:
    """Counts and document counts of each language, source and term of some rows."""
    lang, source = (pc.fill_null(c, "").dictionary_encode() for c in (lang, source))
    sources = max(1, len(source.dictionary))
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * sources + source.indices.to_numpy(zero_copy_only=False)
    data, offsets = W.utf8(text)
    for first, last in W.steps(offsets, STEP):
        part = data[offsets[first] : offsets[last]]
        starts, ends, rows = W.words(part, offsets[first : last + 1] - offsets[first], BETWEEN)
        ids, terms = W.coded(W.LOWER[part[~BETWEEN[part]]], starts, ends)
        if not len(ids):
            continue
        many = len(terms)
        row = np.repeat(np.arange(last - first), np.diff(rows))
        of_row, n, _ = _grouped(row * many + ids)  # each document's different terms
        keys, df, n = _grouped(group[first + of_row // many] * many + of_row % many, n)
        place = keys // many
        take = lambda values, at: pc.take(values, pa.array(at)).cast(pa.large_string())
        yield pa.table([take(lang.dictionary, place // sources), take(source.dictionary, place % sources), take(terms, keys % many), pa.array(n), pa.array(df)], names=["lang", "source", "term", "n", "df"])


def _combined(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    whole = pa.concat_tables(tables)
    if len(tables) > 1:
        whole = whole.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")]).rename_columns(["lang", "source", "term", "n", "df"])
    whole = whole.cast(pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())]))
    yield from whole.to_batches(max_chunksize=1 << 16)


def count_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """Counts for each language, source and term, pre-aggregated in tasks of bounded memory."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for found in _counted(*(batch.column(k) for k in range(3))):
                held.append(found)
                rows += len(found)
                if rows >= ROWS:
                    yield from _combined(held)
                    held, rows = [], 0
        if held:
            yield from _combined(held)

    return docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")).mapInArrow(count, COUNTS)


def frequencies(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exactly: long division by thousands, for totals below 9e15."""
    below = max(1, total + PRIOR * kept)
    rest, out = counts.astype(np.int64) + PRIOR, np.zeros(counts.shape, np.int64)
    factor = SCALE
    while factor > 1:
        digit = min(factor, 1000)
        rest = rest * digit
        out = out * digit + rest // below
        rest, factor = rest % below, factor // digit
    return 1 + out


def _chunk(rows: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """A chunk's parts of the pairs' sums, and each source's first terms in it."""
    lang, kept = groups.column("lang")[0].as_py(), groups.column("kept")[0].as_py()
    sources = np.array(groups.column("source").to_pylist(), object)
    by = np.argsort(sources)
    sources, totals = sources[by], groups.column("total").to_numpy()[by]
    encoded = pc.dictionary_encode(rows.column("term").combine_chunks())
    names = np.array([x.encode() for x in encoded.dictionary.to_pylist()], object)
    terms = np.sort(names)
    place = np.searchsorted(terms, names)[encoded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
    group = np.searchsorted(sources, np.array(rows.column("source").to_pylist(), object)) if len(rows) else place
    width = len(terms)
    # bincount's weights are floats, so the counts are added in halves that these hold exactly.
    n, cells = rows.column("n").to_numpy(), group * width + place
    high, low = (np.bincount(cells, part, len(sources) * width).astype(np.int64) for part in (n >> 26, n & ((1 << 26) - 1)))
    counts = ((high << 26) + low).reshape(len(sources), width)
    p = np.stack([frequencies(counts[k], int(t), kept) for k, t in enumerate(totals)]) if len(sources) else counts
    whole = frequencies(counts.sum(axis=0), int(totals.sum()), kept)
    ids = np.zeros(width, np.int64)
    ids[place] = rows.column("id").to_numpy()
    out = {"source": [], "part": [], "item": [], "value": [], "id": []}

    def add(source: str, part: str, items: list, values: np.ndarray, numbers: list) -> None:
        for key, more in zip(out, ([source] * len(items), [part] * len(items), items, values.tolist(), numbers), strict=True):
            out[key] += more

    for k, source in enumerate(sources):
        others = np.arange(len(sources)) != k
        add(source, "pair", sources[others].tolist(), np.abs(p - p[k]).sum(axis=1)[others], [None] * int(others.sum()))
        over = np.flatnonzero((counts[k] > 0) & (p[k] > whole))
        best = over[np.lexsort((over, whole[over] - p[k][over]))[:top]]
        add(source, "term", [terms[i].decode() for i in best], (p[k] - whole)[best], ids[best].tolist())
    return pa.table([pa.array([lang] * len(out["item"]), pa.string()), *[pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]], names=["lang", *out])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """For each source of each language its distance to each other source, and the terms that it uses more than the language does.

    Columns lang, source, part (``pair`` or ``term``), item, value and rank as the module's query returns them. Null texts,
    languages and sources count as empty ones. Rows count one by one, whatever their ids, so repeated rows count again. A
    language without kept terms has pairs of value 0; a language of one source has no pairs; an empty table has no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    terms = Window.partitionBy("lang", "term")
    # Dealt by language and term, so that sources are added up and documents are counted without another shuffle.
    counts = count_terms(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    kept = scratch.table("kept", counts.withColumn("docs", F.sum("df").over(terms)).filter(F.col("docs") >= min_docs).select("lang", "term", "source", "n"))
    ordered = kept.select("lang", "term").distinct().repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    ordered = scratch.table("ordered", ordered.withColumn("placed", F.monotonically_increasing_id()).withColumn("part", F.shiftright("placed", 33)))
    # Ids without gaps: each stored part of a language begins where the parts before end, so chunks are full however many parts there are.
    parts = ordered.groupBy("lang", "part").agg(F.min("placed").alias("first"), F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dictionary = ordered.join(parts.withColumn("before", before), ["lang", "part"]).select("lang", "term", (F.col("placed") - F.col("first") + F.col("before")).alias("id"))
    every = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").join(dictionary.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    groups = scratch.table("groups", groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept")]))
    width = groups.groupBy("lang").agg(F.greatest(F.lit(16), F.least(F.lit(CHUNK), F.floor(F.lit(CELLS) / F.count("*")))).alias("width"))
    cut = dictionary.join(width, "lang").select("lang", "term", "id", F.floor(F.col("id") / F.col("width")).alias("chunk"))
    coded = kept.join(cut, ["lang", "term"])
    chunks = groups.select("lang").distinct().join(cut.select("lang", "chunk").distinct(), "lang", "left").withColumn("chunk", F.coalesce("chunk", F.lit(-1)))
    beside = groups.join(chunks, "lang")
    found = coded.groupBy("lang", "chunk").cogroup(beside.groupBy("lang", "chunk")).applyInArrow(lambda rows, beside: _chunk(rows, beside, top), PARTS)
    found = scratch.table("parts", found)
    mine = Window.partitionBy("lang", "source")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(mine.orderBy(F.col("value").desc(), "item")))
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(mine.orderBy(F.col("value").desc(), "id"))).filter(F.col("rank") <= top)
    return pairs.unionByName(best.drop("id")).select("lang", "source", "part", "item", "value", "rank")


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and each source's first 50 terms, over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
