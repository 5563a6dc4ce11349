"""N-gram Jaccard join: a size-aware heavy-light join, and the components of its links.

Every text is the set of its word shingles; two texts link when ``100 * intersection >= percent * union``. The plan:

1. Equal sets collapse to one representative, so copies of any number cost one set.
2. A set lacks at most some l of its shingles in a partner. Its 1.5 l + 1 shingles with the smallest hashes are probed; of two
   linked sets the one whose probes end first has at least 0.5 l + 1 of them among the other's. So a set stays only if at
   least that many of its probes, l taken for its smallest possible partner, are also probes of other sets. Sets that only
   share a passage with others mostly drop out.
3. Of the remaining sets, all shingles are counted and ordered rarest first. A linked set has at least ``percent`` per cent of its
   shingles in common with others; those with fewer drop out.
4. Light sets, up to a size boundary, enumerate the two-element subsets of their prefix: a partner shares one of them. Heavy
   sets scan the inverted lists of their prefix shingles; sets just above the boundary do both, so that pairs across it meet.
   The boundary is where enumerating subsets costs as much as scanning lists of the measured mean length.
5. Each list links its members to one leader, the set with the fewest rare shingles, checked exactly on the shingles. Only
   lists whose members are then still in several components are joined with themselves, for pairs across components.
   So a large group of near copies costs its size, not its square, and no link that joins two components is lost. A long list of
   texts that share a good part without linking (a template) still costs the square of its size in comparisons, dealt to
   as many tasks as it has parts of ``PART`` members.

Everything is exact: hashes of 64 bits stand for shingles, 128 bits for sets. Nothing is capped.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text with fewer words than a
shingle is one shingle; an empty table gives an empty result; rows that share an id count as texts of that one id;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.identity import identified
from millrace.llm.words import hashes, mix, ngrams, steps, utf8, words
from millrace.session import Scratch

WORDS, PERCENT = 4, 85
#: Parts of a hot leader's members: its set is sent once to each part.
SALTS = 64
#: Members of a list that one task compares with all of it.
PART = 20_000
#: The largest size that may enumerate subsets.
MOST_LIGHT = 200


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[0] .. starts[0] + counts[0] - 1, and so on for each pair."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, ascending, and the offsets of the rows."""
    starts, ends, at = words(data, offsets)
    h = hashes(data, starts, ends)
    rows, counts = len(offsets) - 1, np.diff(at)
    doc = np.repeat(np.arange(rows), counts)
    grams = ngrams(h, width)
    full = doc[: len(grams)] == doc[width - 1 :] if len(grams) else np.zeros(0, bool)
    owner, values = doc[: len(grams)][full], grams[full]
    for c in range(1, width):  # a text of fewer words is one shingle
        short = np.flatnonzero(counts == c)
        whole = np.full(len(short), c, np.uint64)
        for j in range(c):
            whole = mix(whole ^ h[at[short] + j]) * np.uint64(0xFF51AFD7ED558CCD)
        owner, values = np.concatenate([owner, short]), np.concatenate([values, whole])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])


def _least_overlap(size, percent: int):
    """The fewest common elements of a set of this size and any set that it links with."""
    return (size * percent + 99) // 100


def _probed(size, percent: int):
    """How many of a set's shingles are probed."""
    lacking = size - _least_overlap(size, percent)
    return np.minimum(size, lacking + (lacking + 1) // 2 + 1)


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, set size, 128-bit signature and prefix by hash of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets):
                values, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                n = np.diff(at)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(seed)))]) for seed in (0x51ED270B, 0xA1B2C3D4E5F60718)]
                first, second = (s[at[1:]] - s[at[:-1]] for s in sums)
                keep = _probed(n, percent)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(values[ragged(at[:-1], keep)].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n.astype(np.int64)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), prefix], ["id", "n", "s1", "s2", "prefix"]
                )

    return docs.select(id_col, text_col).mapInArrow(sketch, f"id {kind}, n long, s1 long, s2 long, prefix array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets):
                values, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(at)), tokens], ["id", "size", "tokens"])

    return docs.select(id_col, text_col).mapInArrow(collect, f"id {kind}, size long, tokens array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that link. Many x may have one y: its set goes to SALTS parts of them."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)))
    ours = sets.select(F.col("id").alias("x"), F.col("size").alias("size_x"), F.col("tokens").alias("tokens_x"))
    theirs = sets.select(F.col("id").alias("y"), F.col("size").alias("size_y"), F.col("tokens").alias("tokens_y"))
    sent = salted.select("y", "salt").distinct().join(theirs, "y")
    both = F.size(F.array_intersect("tokens_x", "tokens_y")).cast("long")
    met = salted.join(ours, "x").join(sent, ["y", "salt"]).select("x", "y", "size_x", "size_y", both.alias("both"))
    return met.filter(100 * F.col("both") >= percent * (F.col("size_x") + F.col("size_y") - F.col("both"))).select("x", "y")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _lists(survivors: DataFrame, percent: int, boundary: int) -> DataFrame:
    """(key, id, size, place): the subsets of light sets, the prefix shingles of heavy ones. place: rarer shingles before."""
    size, rare = F.col("size"), F.col("size") - F.size("shared")
    least = F.floor((size * percent + 99) / 100)

    def prefix(extra: int) -> Column:
        return F.slice("shared", 1, F.greatest(F.lit(0), F.least(F.size("shared"), size - least + extra - rare)).cast("int"))

    pairs = F.flatten(
        F.transform(prefix(2), lambda p, i: F.transform(F.slice("shared", 1, i), lambda q: F.struct(F.xxhash64(F.lit("two"), q["key"], p["key"]).alias("key"), (rare + i).alias("place"))))
    )
    ones = F.transform(prefix(1), lambda p, i: F.struct(F.xxhash64(F.lit("one"), p["key"]).alias("key"), (rare + i).alias("place")))
    light, heavy = size <= boundary, size > boundary
    straddles = heavy & (F.floor(F.lit(percent) * size / 100) <= boundary)
    none = F.array().cast("array<struct<key:bigint,place:bigint>>")
    chosen = F.concat(F.when(light | straddles, pairs).otherwise(none).cast(none_type := "array<struct<key:bigint,place:bigint>>"), F.when(heavy, ones).otherwise(none).cast(none_type))
    return survivors.select("id", "size", F.explode(chosen).alias("k")).select("k.key", "id", "size", "k.place")


def _active(sketches: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The representatives of which enough probed shingles occur in other sets."""
    reps = sketches.join(classes.select(F.col("rep").alias("id"), "n", "s1", "s2"), ["id", "n", "s1", "s2"], "left_semi")
    probes = reps.select("id", "n", F.explode("prefix").alias("key"))
    seen = probes.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    smallest = F.floor((F.col("n") * percent + 99) / 100)
    lacking = smallest - F.floor((smallest * percent + 99) / 100)
    return probes.join(seen, "key", "left_semi").groupBy("id", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= F.floor((lacking + 1) / 2) + 1).select("id")


def _survivors(sets: DataFrame, percent: int) -> DataFrame:
    """(id, size, shared): the shingles that other sets have too, rarest first, of the sets that share enough."""
    tokens = sets.select("id", "size", F.explode("tokens").alias("key"))
    common = tokens.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = tokens.join(common, "key").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("shared"))
    return shared.filter(100 * F.size("shared") >= percent * F.col("size"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Links go by id: a row with a null id is linked with nothing and its component is null. ``jaccard_stage`` gives such rows keys.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-join")
    sketches = scratch.table("sketches", _sketches(docs, id_col, text_col, width, percent))
    base = scratch.table("base", sketches.drop("prefix"))
    classes = scratch.table("classes", base.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")))
    active = scratch.table("active", _active(sketches, classes, percent))
    del sketches
    scratch.drop("sketches")
    scratch.release()
    sets = scratch.table("sets", _sets(docs.join(active.select(F.col("id").alias(id_col)), id_col, "left_semi"), id_col, text_col, width))
    scratch.release()
    survivors = scratch.table("survivors", _survivors(sets, percent))
    scratch.drop("sets")
    scratch.release()

    spread = survivors.select(F.explode("shared.n").alias("n")).agg(F.sum("n") / F.count("*")).first()[0]
    boundary = int(min(MOST_LIGHT, max(0.0, (2 * (spread or 0) - 2) / (1 - percent / 100))))
    lists = scratch.table("lists", _lists(survivors, percent, boundary))
    known = survivors.select("id", "size", F.col("shared.key").alias("tokens"))

    leaders = lists.groupBy("key").agg(F.min(F.struct("place", "id", "size")).alias("lead"), F.count("*").alias("c")).filter("c > 1")
    led = lists.join(leaders, "key").filter((F.col("id") != F.col("lead.id")) & _fits(F.col("size"), F.col("lead.size"), percent))
    stars = scratch.table("stars", _linked(led.select(F.col("id").alias("x"), F.col("lead.id").alias("y")).distinct(), known, percent))
    labels = components(stars, scratch, "first")

    named = lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")).filter("low <> high")
    parts = mixed.select("key", F.ceil(F.col("members") / PART).alias("parts"))
    rest = scratch.table("rest", named.join(parts, "key"))
    # A long list's pairs are dealt to several tasks: each takes a part of the one side and all of the other.
    p = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts"))).alias("p")
    q = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("q")
    a, b = F.col("p.size"), F.col("q.size")
    # A true link meets in the list of its first common element, where the elements left over bound the overlap.
    left = 1 + F.least(a - F.col("p.place") - 1, b - F.col("q.place") - 1) + F.when((a <= boundary) | (b <= boundary), 1).otherwise(0)
    across = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.part") == F.col("q.part")) & (F.col("p.label") < F.col("q.label")) & _fits(a, b, percent)).filter((100 + percent) * left >= percent * (a + b))
    more = scratch.table("more", _linked(across.select(F.col("p.id").alias("x"), F.col("q.id").alias("y")).distinct(), known, percent))
    final = components(stars.union(more), scratch, "last")

    reps = classes.join(final, classes["rep"] == final["id"], "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("component_id"))
    out = base.join(reps, ["n", "s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the smallest id; five-word shingles, 80 per cent.

    Where ids are null or repeated, the first stored row of each component stays instead; all other rows of it go, equal ones too.
    """
    scratch, columns = Scratch(spark, "jaccard-stage"), docs.columns
    docs, key = identified(docs, scratch)
    found = jaccard_join(docs, key, width=5, percent=80).filter(F.col("component_id") != F.col(key)).select(key)
    removed = scratch.table("removed", found)
    return docs.join(removed, key, "left_anti").select(*columns)


#: DuckDB: all pairs that share a shingle, and the smallest id that links reach.
SQL = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
  FROM w
),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
l AS (
  SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.k + ny.k - i)
),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT w.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
