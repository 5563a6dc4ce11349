"""Runs of words that repeat with a period, by Crochemore's partition refinement, and texts with each run cut to its first period.

For each length the positions of a text are in classes of equal factors of that length. From one length to the next a class
splits by the classes of the following positions, and only the smaller parts of the last splits are looked at, so that all
lengths together move each position a logarithmic number of times. Where neighbours in a class lie exactly one length apart a
square of that period begins (a primitive one: else there would be a nearer neighbour), and squares that begin at successive
positions are one run. All texts of a batch are refined together.

A text is one unit of work: it needs some 150 bytes for each of its words, and a vectorised step for each length up to the
longest period (a quarter of its words) as long as any factor of that length occurs twice in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.llm import words as W

#: Shortest run in words, and how often its period has to fit.
SHORTEST, TIMES = 6, 4
#: Bytes of text that are refined together.
STEP = 4 << 20

RUNS = "runs array<struct<start: long, length: long, period: long>>, collapsed binary"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where the first element of each run of equal keys stands, as flags."""
    flags = np.zeros(len(keys[0]), bool)
    flags[:1] = True
    for key in keys:
        flags[1:] |= key[1:] != key[:-1]
    return flags


def _last(key: np.ndarray) -> np.ndarray:
    flags = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=flags[:-1])
    return flags


def _sizes(heads: np.ndarray, n: int) -> np.ndarray:
    return np.diff(heads, append=n)


class Partition:
    """Positions in classes of equal factors. A class is a stretch of ``order`` and, by place in the text, a linked list.

    ``at`` gives for each text where its words begin; each text is followed by one place that is a class of its own, as are all
    places whose factor would run over the text's end. Place 0 is in front of the first text.
    """

    def __init__(self, at: np.ndarray, sizes: np.ndarray, word: np.ndarray):
        self.n = n = int(at[-1] + sizes[-1] + 1)
        place = _spans(at, sizes)
        text = np.repeat(np.arange(len(at)), sizes)
        by = np.argsort(text * (int(word.max(initial=0)) + 1) + word, kind="stable")
        first = _heads(text[by], word[by])
        rest = np.ones(n, bool)
        rest[place] = False
        rest = np.flatnonzero(rest)
        self.order = np.concatenate([place[by], rest])
        self.slot = np.empty(n, np.int64)
        self.slot[self.order] = np.arange(n)
        label = np.concatenate([np.cumsum(first) - 1, first.sum() + np.arange(len(rest))])
        self.cls = np.empty(n, np.int64)
        self.cls[self.order] = label
        self.classes = int(label[-1]) + 1
        self.size, self.start = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.size[: self.classes] = np.bincount(label, minlength=self.classes)
        self.start[: self.classes] = np.cumsum(self.size[: self.classes]) - self.size[: self.classes]
        self.next, self.prev = np.full(n, -1), np.full(n, -1)
        same = np.flatnonzero(~first[1:])
        self.next[place[by][same]] = place[by][same + 1]
        self.prev[place[by][same + 1]] = place[by][same]
        self.born, self.found = np.ones(n, np.int64), []
        # At length 0 a text is one class, so that all its classes but one of the largest are the small parts of length 1.
        heads = np.flatnonzero(first)
        owner, large = text[by][heads], self.size[: len(heads)]
        ranked = np.lexsort((large, owner))
        largest = ranked[_last(owner[ranked])]
        small = np.ones(len(heads), bool)
        small[largest] = False
        self.small = place[by][np.repeat(small, large)]
        self.dead, self.leaves = np.zeros(n, bool), np.zeros(n, bool)
        self.dead[rest] = True

    def _gaps(self, place: np.ndarray, length: int) -> None:
        """Neighbours of these places part from ``length`` + 1 on: squares where the gap is a length at which they were neighbours."""
        after = self.next[place]
        gap = after - place
        hit = (after >= 0) & (gap <= length) & (gap >= self.born[place])
        if hit.any():
            self.found.append((place[hit], gap[hit]))

    def refine(self, length: int, ends: np.ndarray) -> None:
        """From ``length`` to the next. ``ends``: the first place of each text that no factor of ``length`` begins at."""
        self.dead[ends - 1] = True
        if not len(self.small):
            self._shorten(ends - 1, length)
            return
        before = np.sort(np.concatenate([self.small, ends]) - 1)
        before = before[self.size[self.cls[before]] > 1]
        self.small = before[:0]
        if not len(before):
            return
        owner = self.cls[before]
        by = np.argsort(owner * self.n + self.cls[before + 1], kind="stable")
        member, owner, follows = before[by], owner[by], self.cls[before + 1][by]
        new_owner = _heads(owner)
        heads = np.flatnonzero(_heads(owner, follows))
        count = _sizes(heads, len(member))
        group_owner = owner[heads]
        owner_of = np.cumsum(new_owner[heads]) - 1  # of each group, the number of its class among those touched
        touched = group_owner[new_owner[heads]]
        moved_of = np.bincount(owner_of, count).astype(np.int64)
        left = self.size[touched] - moved_of
        # A class whose members all move keeps its largest group in place.
        largest = np.maximum.reduceat(count, np.flatnonzero(new_owner[heads]))
        ranked = np.lexsort((count, owner_of))
        last = ranked[_last(owner_of[ranked])]
        stays = np.zeros(len(heads), bool)
        stays[last[left == 0]] = True
        left = np.where(left == 0, largest, left)
        # Small parts: all but the largest part of each class that splits.
        splits = self.size[touched] > left
        rest_small = splits & (largest > left)
        small = splits[owner_of] & ~stays
        small[last[rest_small]] = False
        chosen = [member[np.repeat(small, count)]]
        moves = np.repeat(~stays, count)
        member, owner = member[moves], owner[moves]
        if len(member):
            self._move(member, owner, np.cumsum(~stays)[np.repeat(np.arange(len(heads)), count)[moves]] - 1, length)
        if rest_small.any():
            rest = touched[rest_small]
            chosen.append(self.order[_spans(self.start[rest], self.size[rest])])
        small = np.concatenate(chosen)
        self.small = small[~self.dead[small]]

    def _shorten(self, place: np.ndarray, length: int) -> None:
        """Only the last places of texts leave their classes, one of a class; each is the last of its list."""
        owner = self.cls[place]
        shared = self.size[owner] > 1
        place, owner = place[shared], owner[shared]
        if not len(place):
            return
        left = self.prev[place]
        gap = place - left
        hit = (gap <= length) & (gap >= self.born[left])
        if hit.any():
            self.found.append((left[hit], gap[hit]))
        self.next[left] = -1
        self.prev[place] = -1
        self.size[owner] -= 1
        tail, slots = self.start[owner] + self.size[owner], self.slot[place]
        there = self.order[tail]
        self.order[slots], self.slot[there] = there, slots
        self.order[tail], self.slot[place] = place, tail
        self._grow(len(place))
        self.cls[place] = fresh = np.arange(self.classes, self.classes + len(place))
        self.size[fresh], self.start[fresh] = 1, tail
        self.classes += len(place)

    def _grow(self, by: int) -> None:
        if self.classes + by > len(self.size):
            more = np.zeros(max(by, len(self.size)), np.int64)
            self.size, self.start = np.concatenate([self.size, more]), np.concatenate([self.start, more])

    def _move(self, member: np.ndarray, owner: np.ndarray, group: np.ndarray, length: int) -> None:
        """Members, ordered by class, group and place, leave their classes for new ones, one for each group."""
        # Out of the lists: by class and place, so that neighbours that leave together are one gap.
        by = np.lexsort((member, owner))
        leaving, before, after = member[by], self.prev[member[by]], self.next[member[by]]
        begins, finishes = np.ones(len(by), bool), np.ones(len(by), bool)
        begins[1:] = finishes[:-1] = before[1:] != leaving[:-1]
        left, right = before[begins], after[finishes]
        self._gaps(left[left >= 0], length)
        both = left >= 0
        self.next[left[both]] = right[both]
        self.born[left[both]] = length + 1
        both = right >= 0
        self.prev[right[both]] = left[both]
        # Into the new ones; a gap that stays as it was goes on.
        joined = ~_last(group)
        following = np.full(len(member), -1)
        following[joined] = member[1:][joined[:-1]]
        changed = following != self.next[member]
        self._gaps(member[changed], length)
        self.next[member] = following
        self.born[member[changed]] = length + 1
        preceding = np.full(len(member), -1)
        preceding[1:][joined[:-1]] = member[:-1][joined[:-1]]
        self.prev[member] = preceding
        # To the ends of their classes' stretches; what stands there and stays takes the free places.
        heads = np.flatnonzero(_heads(owner))
        count = _sizes(heads, len(member))
        old = owner[heads]
        kept = self.size[old] - count
        tail = _spans(self.start[old] + kept, count)
        slots = self.slot[member]
        free = slots[slots < np.repeat(self.start[old] + kept, count)]
        there = self.order[tail]
        self.leaves[member] = True
        stay = there[~self.leaves[there]]
        self.leaves[member] = False
        self.order[free] = stay
        self.slot[stay] = free
        self.order[tail] = member
        self.slot[member] = tail
        self.size[old] = kept
        firsts = np.flatnonzero(_heads(group))
        fresh = self.classes + np.arange(len(firsts))
        sizes = _sizes(firsts, len(member))
        self._grow(len(fresh))
        self.size[fresh], self.start[fresh] = sizes, tail[firsts]
        self.cls[member] = np.repeat(fresh, sizes)
        self.classes += len(fresh)


def squares(at: np.ndarray, sizes: np.ndarray, word: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of all primitive squares whose period fits ``times`` into its text."""
    part = Partition(at, sizes, word)
    longest = sizes // times
    live = np.argsort(-longest, kind="stable")
    deepest, stops = longest[live], (at + sizes)[live]
    length = 1
    while len(live) and deepest[0] >= length:
        if length & (length - 1) == 0:  # at powers of two, texts in which no factor occurs twice any more are done
            repeated = np.concatenate([[0], np.cumsum(part.next >= 0)])
            going = repeated[stops] > repeated[at[live]]
            live, deepest, stops = live[going], deepest[going], stops[going]
        # A gap of d counts if it is there at length d, so lengths go up to one more than the longest period.
        if len(live) and deepest[-1] < length:
            many = int(np.searchsorted(-deepest, -length, "right"))
            live, deepest, stops = live[:many], deepest[:many], stops[:many]
        if not len(live):
            break
        if len(part.small) and len(live) < len(at):
            wanted = np.zeros(len(at), bool)
            wanted[live] = True
            part.small = part.small[wanted[np.searchsorted(at, part.small, "right") - 1]]
        part.refine(length, stops - (length - 1))
        length += 1
    part._gaps(np.flatnonzero(part.next >= 0), length)
    if not part.found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, period = np.concatenate([p for p, _ in part.found]), np.concatenate([g for _, g in part.found])
    fits = period <= longest[np.searchsorted(at, place, "right") - 1]  # texts that were left earlier keep longer gaps
    return place[fits], period[fits]


def runs(at: np.ndarray, sizes: np.ndarray, word: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of each run, by text, start and period."""
    place, period = squares(at, sizes, word, times)
    text = np.searchsorted(at, place, "right") - 1
    by = np.lexsort((place, period, text))
    place, period, text = place[by], period[by], text[by]
    heads = np.flatnonzero(_heads(text, period, place - np.arange(len(place))))
    lengths = _sizes(heads, len(place)) - 1 + 2 * period[heads]
    keep = lengths >= np.maximum(shortest, times * period[heads])
    heads, lengths = heads[keep], lengths[keep]
    text, start, period = text[heads], place[heads] - at[text[heads]], period[heads]
    by = np.lexsort((period, start, text))
    return text[by], start[by], lengths[by], period[by]


def _batch(column: pa.Array, shortest: int, times: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each row."""
    listed, collapsed = [], []
    data, offsets = W.utf8(column)
    for first, last in W.steps(offsets, STEP):
        part = data[offsets[first] : offsets[last]]
        starts, ends, rows = W.words(part, offsets[first : last + 1] - offsets[first])
        sizes = np.diff(rows)
        at = rows[:-1] + np.arange(len(sizes)) + 1  # one place in front, one after each text
        letters = part[~W.SPACE[part]]
        cuts = np.concatenate([[0], np.cumsum(ends - starts)])
        ids = W.coded(letters, starts, ends)[0]
        text, start, length, period = runs(at, sizes, ids, shortest, times)
        # Words that a run holds after its first period are dropped: differences of counts, summed up.
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, rows[text] + start + period, 1)
        np.add.at(change, rows[text] + start + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        width = (ends - starts + 1) * kept
        spaced = np.full(int(width.sum()), 0x20, np.uint8)
        kept_starts, kept_sizes = cuts[:-1][kept], (ends - starts)[kept]
        into = np.cumsum(kept_sizes + 1) - (kept_sizes + 1)
        spaced[_spans(into, kept_sizes)] = letters[_spans(kept_starts, kept_sizes)]
        stops = np.concatenate([[0], np.cumsum(width)])[rows]
        whole = spaced.tobytes()
        collapsed += [whole[a : max(a, b - 1)] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        places = np.searchsorted(text, np.arange(len(sizes) + 1))
        found = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], fields=list(_RUNS.value_type))
        listed.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), found))
    if not listed:
        return pa.array([], _RUNS), pa.array([], pa.binary())
    return pa.concat_arrays([x.cast(_RUNS) for x in listed]), pa.array(collapsed, pa.binary())


def find_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """All columns of ``docs`` but the text, and ``runs`` and ``collapsed`` in place of columns of these names.

    ``runs``: start, length and period of each stretch of words that has a smallest period, holds it at least ``times`` times, is
    at least ``shortest`` words long and can't be extended; by start and period. ``collapsed``: the words joined by one space
    without those that a run holds after its first period, as UTF-8 bytes. Null and empty texts have no runs and collapse to the
    empty text. Each row is looked at for itself, so copies, repeated rows and null ids have their own results.
    """
    if shortest < 2 or times < 2:
        raise ValueError("runs are at least two words long and hold their period twice")
    rest = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    schema = docs.select(*rest).schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, collapsed = _batch(batch.column(batch.schema.get_field_index(text)), shortest, times)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, found, collapsed], names=[*rest, "runs", "collapsed"])

    return docs.select(*rest, text).mapInArrow(find, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], RUNS]))


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for one id in ten, the words from some place on repeat a short stretch: the query's documents."""
    hashed = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(hashed / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(hashed % 10 == 0, let(words, tail)).otherwise(text)


def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document how many runs it has, the longest (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
