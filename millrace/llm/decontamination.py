"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are sequences of words, A-Z lower-cased and without ASCII punctuation at their ends. A document holds an item of m words
if some stretch of it is within ``floor(m * EDITS)`` word edits of the item; items of fewer than five words have to occur as they are.

1. Anchors. With at most that many edits, an item keeps ``anchor_width(m)`` successive words intact: three, or two for five words, or
   all of an item of one or two. So a window of the item's size is placed wherever that many words of an item occur, at the item's own
   offset. This loses nothing.
2. Every window and every item go through the CGK embedding: a pointer walks along the words, advancing by one random bit of the
   step and the current word, and the words it visits are the embedding. Within a small edit distance walks soon meet again, so
   edit distance becomes Hamming distance. Each of L independent walks is sampled at K random steps; a window is a candidate
   for the items of its size with the same sample in any walk. K and L are chosen for each size on items edited at random as far
   as the threshold allows, so that the wanted share of such pairs is found: the largest K for which ``MOST_WALKS`` walks or fewer do.
   Sizes that reach it with none (long items) have an exact way instead: all items whose anchor placed the window are candidates.
3. Candidates are verified exactly, by the edit distance of the item to the best stretch around the window.

The benchmark's different texts go through in blocks of ``ITEM_BLOCK``, each a bounded table sent to all tasks; documents stay where
they lie and are read once for each block.

Defined results: null and empty texts hold nothing; items without words match nothing; equal items are each reported; of several
stretches for one item the closest, then the first, is reported; repeated rows are each reported; empty tables give an empty
result; other columns are kept by ``decontaminate_stage`` and not read otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.identity import identified
from millrace.llm.words import hashes, mix, ngrams, steps, utf8, words
from millrace.session import Scratch

EDITS = 0.2
ANCHOR = 3
SAMPLED, RECALL, MOST_WALKS, TRIALS = 3, 0.99, 128, 512
ITEM_BLOCK = 20_000
#: Windows that are embedded at once.
TOGETHER = 2048
PAD = np.uint64(0)

_CORE = np.zeros(256, bool)
_CORE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_CORE[128:] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the offsets of the rows' words."""
    starts, ends, at = words(data, offsets)
    place = np.arange(len(data))
    core = _CORE[data]
    ahead = np.minimum.accumulate(np.where(core, place, len(data))[::-1])[::-1] if len(data) else place
    behind = np.maximum.accumulate(np.where(core, place, -1)) if len(data) else place
    low, high = ahead[starts] if len(starts) else starts, behind[ends - 1] + 1 if len(ends) else ends
    some = low < ends  # words of punctuation alone stay as they are
    return hashes(data, np.where(some, low, starts), np.where(some, high, ends)) | np.uint64(1), at


def allowed(m: int) -> int:
    return int(m * EDITS + 1e-9)


def anchor_width(m: int) -> int:
    """How many successive words of an item of m words the allowed edits leave intact at least, up to ANCHOR."""
    k = allowed(m)
    return min(ANCHOR, -(-(m - k) // (k + 1)))


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least edits that turn ``item`` into a stretch of ``text``, and that stretch."""
    size = len(text) + 1
    place = np.arange(size)
    cost, origin = np.zeros(size, np.int64), place.copy()
    for w in item:
        new, come = cost + 1, origin.copy()
        swap = cost[:-1] + (text != w)
        better = swap < new[1:]
        new[1:][better], come[1:][better] = swap[better], origin[:-1][better]
        # Words of the text in between: the running least of cost minus place, of equal ones the last.
        best = np.minimum.accumulate(((new - place) << 32) | (size - place))
        origin = come[size - (best & 0xFFFFFFFF)]
        cost = (best >> 32) + place
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


@dataclass
class Walks:
    """The random bits and sampled steps of the walks over windows of one size."""

    seeds: np.ndarray  # walks x steps
    sampled: np.ndarray  # walks x SAMPLED

    @classmethod
    def of(cls, size: int, walks: int, sampled: int = SAMPLED) -> Walks:
        rng = np.random.Generator(np.random.PCG64([97, size, sampled]))
        seeds = rng.integers(1, 1 << 63, (MOST_WALKS, 2 * size), dtype=np.uint64)
        steps_ = np.sort(np.stack([rng.choice(2 * size, min(sampled, 2 * size), replace=False) for _ in range(MOST_WALKS)]), axis=1)
        return cls(seeds[:walks], steps_[:walks])

    def sample(self, x: np.ndarray) -> np.ndarray:
        """One hash for each row of words and each walk."""
        rows, size = x.shape
        padded = np.concatenate([x, np.full((rows, 1), PAD)], axis=1)
        walks, length = self.seeds.shape
        at = np.zeros((walks, rows), np.int64)
        out = np.zeros((walks, rows), np.uint64)
        row = np.arange(rows)[None, :]
        for step in range(int(self.sampled.max()) + 1 if walks else 0):
            word = padded[row, at]
            taken = (self.sampled == step).any(axis=1)
            out[taken] = mix(out[taken] * np.uint64(0x9E3779B97F4A7C15) + word[taken] + np.uint64(step))
            at += (mix(word ^ self.seeds[:, step][:, None]) & np.uint64(1)).astype(np.int64)
            np.minimum(at, size, out=at)
        return out.T


def walks_needed(items: np.ndarray) -> Walks | None:
    """The walks that find the wanted share of these items, all of one size, edited as far as allowed; None if none do."""
    size = items.shape[1]
    rng = np.random.Generator(np.random.PCG64([131, size]))
    some = items[np.linspace(0, len(items) - 1, TRIALS).astype(int)]
    edited = np.full_like(some, PAD)
    for k, row in enumerate(some):
        out = row.tolist()
        for _ in range(allowed(size)):
            at, what = int(rng.integers(0, max(1, len(out)))), rng.integers(0, 3)
            if what == 0 and out:
                out[min(at, len(out) - 1)] = int(rng.integers(1, 1 << 62))
            elif what == 1 and len(out) > 1:
                del out[min(at, len(out) - 1)]
            else:
                out.insert(at, int(rng.integers(1, 1 << 62)))
        edited[k, : min(size, len(out))] = np.array(out[:size], np.uint64)
    for sampled in range(SAMPLED, 0, -1):
        walks = Walks.of(size, MOST_WALKS, sampled)
        found = np.maximum.accumulate(walks.sample(some) == walks.sample(edited), axis=1).mean(axis=0)
        enough = np.flatnonzero(found >= RECALL)
        if len(enough):
            return Walks.of(size, int(enough[0]) + 1, sampled)
    return None


@dataclass
class Index:
    """A block of different items: their anchors and the samples of their walks, by size."""

    texts: list[str]
    words: list[np.ndarray]
    anchors: dict[int, tuple[np.ndarray, ...]]  # by width: ascending hashes, and for each the size, offset and item (-1: by walks)
    maybe: dict[int, np.ndarray]
    walks: dict[int, Walks]
    samples: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # for each walk: ascending samples and their items

    @classmethod
    def build(cls, texts: list[str]) -> Index:
        data, offsets = utf8(pa.array(texts, pa.string()))
        h, at = symbols(data, offsets)
        kept = [k for k in range(len(texts)) if at[k + 1] > at[k]]
        each = [h[at[k] : at[k + 1]] for k in kept]
        sizes = np.array([len(w) for w in each], np.int64)
        walks, samples = {}, {}
        for m in np.unique(sizes):
            same = np.flatnonzero(sizes == m)
            matrix = np.stack([each[k] for k in same])
            if chosen := walks_needed(matrix):
                walks[int(m)] = chosen
                samples[int(m)] = [(np.sort(c), same[np.argsort(c, kind="stable")]) for c in chosen.sample(matrix).T]
        anchors, maybe = {}, {}
        for width in range(1, ANCHOR + 1):
            mine = [k for k in range(len(each)) if anchor_width(int(sizes[k])) == width]
            if mine:
                grams = np.concatenate([ngrams(each[k], width) for k in mine])
                count = sizes[mine] - width + 1
                item = np.repeat([-1 if int(sizes[k]) in walks else k for k in mine], count)
                offset = np.concatenate([np.arange(n) for n in count])
                rows = np.unique(np.stack([grams, np.repeat(sizes[mine], count).astype(np.uint64), offset.astype(np.uint64), (item + 1).astype(np.uint64)]), axis=1)
                anchors[width] = (rows[0], rows[1].astype(np.int64), rows[2].astype(np.int64), rows[3].astype(np.int64) - 1)
                maybe[width] = np.zeros(1 << 20, bool)
                maybe[width][(grams >> np.uint64(44)).astype(np.int64)] = True
        return cls([texts[k] for k in kept], each, anchors, maybe, walks, samples)

    def windows(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, first word, size, item or -1) of each window that an anchor asks for."""
        out = []
        for width, (known, size_of, offset_of, item_of) in self.anchors.items():
            grams = ngrams(h, width)
            some = np.flatnonzero(self.maybe[width][(grams >> np.uint64(44)).astype(np.int64)])
            low, high = (np.searchsorted(known, grams[some], side) for side in ("left", "right"))
            count = high - low
            place, entry = np.repeat(some, count), np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            row = np.searchsorted(at, place, "right") - 1
            inside = place + width <= at[row + 1]
            out.append(np.stack([row[inside], (place - offset_of[entry])[inside], size_of[entry][inside], item_of[entry][inside]]))
        found = np.concatenate([np.zeros((4, 0), np.int64), *out], axis=1)
        return tuple(np.unique(found, axis=1)) if found.shape[1] else tuple(found)

    def candidates(self, x: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) for windows of one size, as rows of words."""
        size, out = x.shape[1], set()
        for sample, (known, item) in zip(self.walks[size].sample(x).T, self.samples[size], strict=True):
            low, high = (np.searchsorted(known, sample, side) for side in ("left", "right"))
            for k in np.flatnonzero(high > low):
                out.update((int(k), int(i)) for i in item[low[k] : high[k]])
        return sorted(out)

    def search(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, end) of the best stretch of each row for each item that it holds."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        row, start, size, asked = self.windows(h, at)

        def verify(r: int, s: int, item: int) -> None:
            m = len(self.words[item])
            k = allowed(m)
            low, high = max(int(at[r]), s - k), min(int(at[r + 1]), s + m + k)
            edits, first, end = distance(self.words[item], h[low:high])
            found = (edits, low + first - int(at[r]), low + end - int(at[r]))
            if edits <= k and found < best.get((r, item), (1 << 60, 0, 0)):
                best[r, item] = found

        for r, s, item in zip(*(c[asked >= 0].tolist() for c in (row, start, asked)), strict=True):
            verify(r, s, item)
        for m in np.unique(size[asked < 0]):
            mine = np.flatnonzero((size == m) & (asked < 0))
            for begin in range(0, len(mine), TOGETHER):
                some = mine[begin : begin + TOGETHER]
                place = start[some][:, None] + np.arange(m)
                inside = (place >= at[row[some]][:, None]) & (place < at[row[some] + 1][:, None])
                x = np.where(inside, h[np.clip(place, 0, len(h) - 1)], PAD)
                for which, item in self.candidates(x):
                    verify(int(row[some[which]]), int(start[some[which]]), item)
        return [(r, i, *v) for (r, i), v in sorted(best.items())]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item, ``edits``, ``item_words``, ``start`` and ``end`` (code points) of each item that a document holds."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    source = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("item_text")).filter("item_text IS NOT NULL")
    different = source.select("item_text").distinct()
    blocks = max(1, -(-different.count() // ITEM_BLOCK))
    block = F.pmod(F.xxhash64("item_text"), F.lit(blocks))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for b in range(blocks):
        index = Index.build(sorted(r["item_text"] for r in different.filter(block == b).collect()))
        found = rows.mapInArrow(_finder(index), f"id {kind}, item_text string, edits int, item_words int, start long, end long")
        out = found if out is None else out.unionByName(found)
    # Equal items are found once and reported each.
    named = out.join(source, "item_text")
    return named.select(F.col("id").alias(id_col), F.col("item").cast(item_kind).alias(item_col), "edits", "item_words", "start", "end")


def _finder(index: Index):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows, hits = [], []
            for a, b in steps(offsets):
                h, at = symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for r, item, edits, first, end in index.search(h, at):
                    spans = [m.span() for m in _WORD.finditer(batch.column(1)[a + r].as_py())]
                    rows.append(a + r)
                    hits.append((index.texts[item], edits, len(index.words[item]), spans[first][0] if first < end else 0, spans[end - 1][1] if first < end else 0))
            columns = list(zip(*hits, strict=True)) if hits else [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "item_text", "edits", "item_words", "start", "end"])

    return find


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; rows with null and repeated ids are judged one by one."""
    scratch, columns = Scratch(spark, "decontaminate-stage"), docs.columns
    docs, key = identified(docs, scratch)
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key).select(F.col(key).alias("_held")).distinct()
    held = scratch.table("held", found)
    return docs.join(held, F.col(key) == F.col("_held"), "left_anti").select(*columns)
