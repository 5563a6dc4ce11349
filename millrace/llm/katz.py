"""Language-model scores: a Katz backoff model of word pairs with Good-Turing discounts and exactly normalised weights.

All training texts are counted. A pair (h, w) seen r times has the probability ``d_r * r / (c(h) + 1)``; d_r is the Good-Turing
discount for r up to ``CUTOFF``, from the counts of counts, and 1 above. What discounts free after h, and the one count set aside
for each history, is shared by the words not seen after h: ``alpha(h) * P(w)``, with alpha(h) such that the probabilities after
h sum to exactly 1. P(w) is discounted in the same way and what is freed there is the probability of an unknown word. Histories
start with a begin mark, texts end with an end mark.

Evaluation. A text's score is a sum over its tokens, so every token is looked up where the tables' partitions lie and only sums
by text come back:

* ``words``: the training count of each word, from partial counts of blocks of texts;
* the ``CODED`` most frequent words (a fixed bound) are known to each task with their counts, as are the counts of the pairs of
  the ``HOT`` most frequent ones; such tokens are resolved where the text is, so no frequent pair makes a hot partition;
* all other tokens go to the part of their word, or of their pair if the word is a coded one, as arrays: a row is one block's
  share of one part. There pairs are counted and looked up; ``facts`` takes the sums by text, the figures of the histories, the
  tokens that back off, and the counted pairs. Parts are dealt in ``TURNS`` turns, which bounds what is on its way at once;
* the backoff weights of the histories, from their figures, are joined to the tokens that back off.

The model stays in tables: words and pairs with their counts, histories with their backoff weights. ``Model.score`` looks up
the tokens of any texts there, one order after the other.

Defined results: a null or empty text is the end mark alone; a word unseen in training has the unknown word's probability; without
training texts each score is 0; repeated rows count and are scored each; an empty table gives an empty result; other columns
aren't read. Where counts of counts don't give a discount in (0, 1), ``1 - 1/(2r)`` takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.identity import fixed_splits
from millrace.llm.words import hashes, mix, steps, utf8, words
from millrace.session import Scratch, arrow_batches

CUTOFF = 5
CODED, HOT = 60_000, 1024
BEGIN, END = np.uint64(0x0B0E6B0E6B0E6B0F), np.uint64(0x0E4D0E4D0E4D0E4D)
BLOCK_BYTES, BLOCK_ROWS, BATCH_BYTES = 2 << 20, 30_000, 8 << 20
#: Training tokens that one partition should get, the fewest partitions, and the tokens that a task works on at once.
PART_TOKENS, PARTS, SLICE = 4_000_000, 24, 250_000
#: The parts are dealt in so many turns, so that only that share of the tokens is on its way at once; pairs stored in a row.
TURNS, CHUNK = 2, 16_000


@dataclass
class Stream:
    """The tokens of a block: hash, history, row; and where the rows begin."""

    token: np.ndarray
    history: np.ndarray
    row: np.ndarray
    first: np.ndarray


def stream(data: np.ndarray, offsets: np.ndarray) -> Stream:
    starts, ends, at = words(data, offsets)
    h = hashes(data, starts, ends)
    rows = np.arange(len(offsets) - 1)
    row = np.repeat(rows, np.diff(at) + 1)
    token = np.empty(len(h) + len(rows), np.uint64)
    token[np.arange(len(h)) + np.repeat(rows, np.diff(at))] = h
    token[at[1:] + rows] = END
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[at[:-1] + rows] = BEGIN
    return Stream(token, history, row, at[:-1] + rows)


def discounts(seen: list[float]) -> np.ndarray:
    """d_1 .. d_CUTOFF from the counts of counts n_1 .. n_(CUTOFF+1)."""
    out = np.array([1 - 1 / (2 * r) for r in range(1, CUTOFF + 1)])
    if seen[0] > 0:
        common = (CUTOFF + 1) * seen[CUTOFF] / seen[0]
        for r in range(1, CUTOFF + 1):
            if seen[r - 1] > 0 and common < 1:
                d = ((r + 1) * seen[r] / seen[r - 1] / r - common) / (1 - common)
                out[r - 1] = d if 0 < d < 1 else out[r - 1]
    return out


def _discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    low = (count >= 1) & (count <= CUTOFF)
    return count * np.where(low, d[np.clip(count, 1, CUTOFF).astype(int) - 1], 1.0)


@dataclass
class Words:
    """What each task knows of single words."""

    total: int
    distinct: int
    discount: np.ndarray
    unknown: float
    spare: float  # the share taken from all words where no discount frees any for the unknown word
    coded: np.ndarray  # ascending hashes
    count: np.ndarray  # of each coded word
    hot: np.ndarray  # place among the hot words, or -1

    def __post_init__(self):
        # Coded words by the first 20 bits of their hash: mostly one or none for each value.
        self.begin = np.searchsorted(self.coded, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.begin = np.append(self.begin, np.int32(len(self.coded)))
        self.crowded = int(np.diff(self.begin).max())

    def code(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the coded words, or -1."""
        top = (h >> np.uint64(44)).astype(np.int32)
        at, end = self.begin[top], self.begin[top + 1]
        out = np.full(len(h), -1, np.int32)
        live = np.flatnonzero(at < end)
        for k in range(self.crowded):
            place = at[live] + k
            hit = self.coded[place] == h[live]
            out[live[hit]] = place[hit]
            live = live[~hit]
            live = live[at[live] + k + 1 < end[live]]
            if not len(live):
                break
        return out

    def codes(self, s: Stream) -> tuple[np.ndarray, np.ndarray]:
        """Of the tokens and of their histories."""
        w = self.code(s.token)
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[s.first] = self.code(np.array([BEGIN]))[0]
        return w, h

    def log_p(self, count: np.ndarray) -> np.ndarray:
        """log10 of P(w) for words with these training counts."""
        known = _discounted(np.maximum(count, 1), self.discount) * (1 - self.spare) / max(self.total, 1)
        return np.log10(np.where(count > 0, known, self.unknown))


def _held(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def count_words(docs: DataFrame, scratch: Scratch) -> Words:
    """The table ``words`` and what tasks know of it. ``docs``: held, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in steps(offsets, BLOCK_BYTES):
                found, n = np.unique(stream(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["word", "c"])

    partial = docs.filter("not held").select("text").mapInArrow(count, "word long, c long")
    table = scratch.table("words", partial.groupBy("word").agg(F.sum("c").alias("c")))
    size = F.floor(4 * F.log2("c")).cast("int")
    levels = table.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum("c").alias("t")).orderBy(F.desc("size")).collect()
    low = {r[0]: r[1] for r in table.filter(F.col("c") <= CUTOFF + 1).groupBy("c").count().collect()}
    total, distinct = sum(r["t"] for r in levels), sum(r["n"] for r in levels)
    least, taken = None, 0
    for r in levels:  # sizes from the largest down, while all their words fit
        if taken + r["n"] > CODED:
            break
        least, taken = r["size"], taken + r["n"]
    rows = table.filter(size >= least).collect() if least is not None else []
    known = {np.uint64(r["word"] & 0xFFFFFFFFFFFFFFFF): r["c"] for r in rows}
    known.setdefault(END, table.filter(F.col("word") == int(END.view(np.int64))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    known[BEGIN] = known[END]
    coded = np.array(sorted(known), np.uint64)
    count = np.array([known[h] for h in coded], np.int64)
    hot = np.full(len(coded), -1)
    best = np.lexsort((coded, -count))[:HOT]
    hot[best] = np.arange(len(best))
    d = discounts([low.get(r, 0) for r in range(1, CUTOFF + 2)])
    freed = sum((1 - d[r - 1]) * r * low.get(r, 0) for r in range(1, CUTOFF + 1)) / max(total, 1)
    spare = 0.0 if freed > 0 else 1 / (total + 1)
    return Words(total, distinct, d, freed or spare, spare, coded, count, hot)


def count_hot(docs: DataFrame, known: Words) -> np.ndarray:
    """Training counts of the pairs of hot words, history by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(HOT * HOT, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in steps(offsets, BLOCK_BYTES):
                s = stream(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                w, h = (np.where(c >= 0, known.hot[c], -1) for c in known.codes(s))
                both = np.flatnonzero((w >= 0) & (h >= 0))
                np.add.at(total, h[both] * HOT + w[both], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "c"])

    out = np.zeros(HOT * HOT, np.int64)
    # At most HOT * HOT rows, whatever the input.
    found = docs.filter("not held").select("text").mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out[found["pair"].to_numpy()] = found["c"].to_numpy()
    return out.reshape(HOT, HOT)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def deal(docs: DataFrame, known: Words, pairs: np.ndarray, parts: int, turn: int = 0) -> DataFrame:
    """Rows of (part, arrays) for the parts of one turn: the tokens to look up, and in turn 0 the sums by text of what is resolved at once.

    ``docs``: uid, held, text, id.
    """
    kind = docs.schema["id"].dataType.simpleString()
    log_count = np.log10(known.count + 1.0)
    log_p = known.log_p(known.count)

    def at_once(s: Stream, w: np.ndarray, h: np.ndarray, hot: np.ndarray, uid: np.ndarray, held: np.ndarray, ids: pa.Array) -> list[pa.Array]:
        """Columns of one row: the sums by text, and the hot tokens that back off."""
        rows = len(uid)
        sums, counts = np.zeros((rows, 2)), np.zeros((rows, _COUNTS), np.int32)
        c = w >= 0
        sums[:, 0] = np.bincount(s.row[c], weights=log_count[w[c]], minlength=rows)
        counts[:, 0] = np.bincount(s.row, minlength=rows)
        counts[:, 1] = np.bincount(s.row[c & (np.where(c, known.count[w], 0) > 0)], minlength=rows)
        r = pairs[known.hot[h[hot]], known.hot[w[hot]]]
        for k in range(1, CUTOFF + 1):
            counts[:, 1 + k] = np.bincount(s.row[hot][r == k], minlength=rows)
        fixed = np.where(r > CUTOFF, np.log10(np.maximum(r, 1)), 0) + np.where(r == 0, log_p[w[hot]], 0)
        sums[:, 1] = np.bincount(s.row[hot], weights=fixed, minlength=rows)
        off = np.flatnonzero(hot)[r == 0]
        return [pa.array(uid), ids, pa.array(held), pa.array(sums.ravel()), pa.array(counts.ravel()), pa.array(s.history[off].view(np.int64)), pa.array(uid[s.row[off]])]

    def share(uid: np.ndarray, held: np.ndarray, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
        s, rows = stream(data, offsets), len(uid)
        w, h = known.codes(s)
        hot = (w >= 0) & (h >= 0)
        hot[hot] = (known.hot[w[hot]] >= 0) & (known.hot[h[hot]] >= 0)
        own = at_once(s, w, h, hot, uid, held, ids) if turn == 0 else None
        part = (mix(np.where(w >= 0, s.token ^ (s.history * np.uint64(0x9E3779B97F4A7C15)), s.token)) % np.uint64(parts)).astype(np.int64)
        some = np.flatnonzero(~hot & (part % TURNS == turn))
        # By part and word; in the order of the rows, which ends the sort key. Words of a part that agree in their first bits may mix.
        bits = np.uint64(max(1, len(s.token).bit_length()))
        key = np.sort((s.token[some] >> bits << bits) | some.astype(np.uint64))
        some = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        some = some[np.argsort(part[some].astype(np.uint16 if parts <= 0xFFFF else np.uint32), kind="stable")]
        token, row, part, code = s.token[some], s.row[some], part[some], h[some]
        run = np.ones(len(token), bool)
        run[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(run)
        rare = code < 0
        present = np.unique(part) if len(part) else uid[: 1 if own else 0] % parts
        ends = lambda p: np.searchsorted(p, present, "right")
        # The rows that have tokens in a part, and each token's place among them.
        mine, place = np.unique(part * rows + row, return_inverse=True)
        mine_ends = ends(mine // rows)
        place -= np.concatenate([[0], mine_ends])[np.searchsorted(present, part)]
        carries = (np.arange(len(present)) >= int(uid[0]) % max(len(present), 1)).astype(np.int64)  # one row of the block carries its sums
        whole = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], carries * len(values)]).astype(np.int32)), values)
        own = own or [pa.array([], pa.int64()), ids[:0], pa.array([], pa.bool_()), pa.array([], pa.float64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(present.astype(np.int32)),
                _lists(uid[mine % rows], mine_ends, pa.int64()),
                _lists(held[mine % rows], mine_ends, pa.bool_()),
                _lists(token[first].view(np.int64), ends(part[first]), pa.int64()),
                _lists(np.diff(np.append(first, len(token))).astype(np.int32), ends(part[first]), pa.int32()),
                _lists(np.where(rare, 0xFFFF, code).astype(np.uint16).view(np.int16), ends(part), pa.int16()),
                _lists(s.history[some[rare]].view(np.int64), ends(part[rare]), pa.int64()),
                _lists(place.astype(np.int16), ends(part), pa.int16()),
                *map(whole, own),
            ],
            _DEALT,
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            uid, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in steps(offsets, BLOCK_BYTES):
                for k in range(a, b, BLOCK_ROWS):
                    end = min(b, k + BLOCK_ROWS)
                    yield share(uid[k:end], held[k:end], batch.column(3)[k:end], data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k])

    return docs.select("uid", "held", "text", "id").mapInArrow(blocks, _DEALT_SCHEMA.format(kind=kind))


_DEALT = ["part", "uids", "helds", "tokens", "runs", "codes", "rares", "rows", "sum_uids", "sum_ids", "sum_helds", "sums", "sum_counts", "off_h", "off_uids"]
_DEALT_SCHEMA = (
    "part int, uids array<long>, helds array<boolean>, tokens array<long>, runs array<int>, codes array<short>, rares array<long>, rows array<short>, "
    "sum_uids array<long>, sum_ids array<{kind}>, sum_helds array<boolean>, sums array<double>, sum_counts array<int>, off_h array<long>, off_uids array<long>"
)
#: Kinds of facts: sums of a text; figures of a history; tokens of a text that back off after a history; counted pairs.
TEXT, HISTORY, BACKOFF, PAIRS = 0, 1, 2, 3
#: Counts of a text: tokens, known ones, pairs seen 1 .. CUTOFF times; of a history: 0, pairs seen 1 .. CUTOFF + 1 times.
_COUNTS = CUTOFF + 2
_FACTS = ["kind", "key", "uid", "id", "held", "a", "b", *[f"n{k}" for k in range(_COUNTS)], "pairs", "counts"]
_FACTS_SCHEMA = "kind byte, key long, uid long, id {kind}, held boolean, a double, b double, " + ", ".join(f"n{k} int" for k in range(_COUNTS)) + ", pairs array<long>, counts array<int>"


def look_up(dealt: DataFrame, known: Words) -> DataFrame:
    """The facts of each part. A part's tokens are worked on in slices of the words' hashes, and each slice's facts go out before the next."""
    id_kind = dealt.schema["sum_ids"].dataType.elementType.simpleString()

    def facts(kind: int, rows: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
        types = {"key": pa.int64(), "uid": pa.int64(), "id": id_type, "held": pa.bool_(), "a": pa.float64(), "b": pa.float64(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int32())}
        out = [pa.array(np.full(rows, kind, np.int8))]
        for name in _FACTS[1:]:
            t = types.get(name, pa.int32())
            v = columns.get(name)
            out.append(pa.nulls(rows, t) if v is None else v if isinstance(v, pa.Array) else pa.array(v, t))
        return pa.RecordBatch.from_arrays(out, _FACTS)

    def texts(uid: np.ndarray, sums: np.ndarray, counts: np.ndarray, id_type: pa.DataType, ids: pa.Array | None = None, held: pa.Array | None = None) -> pa.RecordBatch:
        return facts(TEXT, len(uid), id_type, uid=uid, id=ids, held=held, a=sums[:, 0].copy(), b=sums[:, 1].copy(), **{f"n{k}": counts[:, k].copy() for k in range(_COUNTS)})

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, uids, helds, most, id_type = [], [], [], 0, pa.null()
        for batch in batches:
            get = {n: batch.column(_DEALT.index(n)) for n in _DEALT[1:]}
            id_type = get["sum_ids"].type.value_type
            if len(own := get["sum_uids"].flatten()):
                yield texts(own.to_numpy(), get["sums"].flatten().to_numpy().reshape(-1, 2), get["sum_counts"].flatten().to_numpy().reshape(-1, _COUNTS), id_type, get["sum_ids"].flatten(), get["sum_helds"].flatten())
            if len(off := get["off_h"].flatten()):
                yield facts(BACKOFF, len(off), id_type, key=off, uid=get["off_uids"].flatten(), n0=np.ones(len(off), np.int32))
            for k in range(batch.num_rows):
                one = {n: get[n][k].values.to_numpy(zero_copy_only=False) for n in ("uids", "helds", "tokens", "runs", "codes", "rares", "rows")}
                # Copied, so that the batch's other columns can go.
                blocks.append([one["tokens"].view(np.uint64).copy(), np.concatenate([[0], np.cumsum(one["runs"])]), one["codes"].view(np.uint16).copy(), one["rares"].view(np.uint64).copy(), one["rows"].copy(), most, 0])
                uids.append(one["uids"].copy())
                helds.append(one["helds"].copy())
                most += len(one["uids"])
        uid, held = np.concatenate([np.zeros(0, np.int64), *uids]), np.concatenate([np.zeros(0, bool), *helds])
        sums, counts = np.zeros((len(uid), 2)), np.zeros((len(uid), _COUNTS), np.int32)
        slices = max(1, -(-sum(len(b[2]) for b in blocks) // SLICE))
        bounds = [np.uint64(k * 2**64 // slices) for k in range(slices)]
        histories = []
        for k in range(slices):
            some = [_slice(b, known, bounds[k], bounds[k + 1] if k + 1 < slices else None) for b in blocks]
            token, history, row = (np.concatenate(c) for c in zip(*some, strict=True)) if some else (np.zeros(0, np.uint64),) * 3
            del some
            if len(token):
                yield from slice_facts(uid, held, token, history, row, sums, counts, histories, id_type)
            del token, history, row
            if histories and (k + 1 == slices or sum(len(f[0]) for f in histories) >= 2 * SLICE):
                yield figures(histories, id_type)
                histories = []
        if len(uid):
            yield texts(uid, sums, counts, id_type)

    def figures(histories: list[tuple[np.ndarray, ...]], id_type: pa.DataType) -> pa.RecordBatch:
        history, mass, seen = (np.concatenate(c) for c in zip(*histories, strict=True))
        keys, at = np.unique(history, return_inverse=True)
        each = {f"n{k}": np.bincount(at[seen == k], minlength=len(keys)).astype(np.int32) for k in range(1, CUTOFF + 2)}
        return facts(HISTORY, len(keys), id_type, key=keys.view(np.int64), a=np.bincount(at, weights=mass, minlength=len(keys)), **each)

    def slice_facts(uid, held, token, history, row, sums, counts, histories, id_type) -> Iterator[pa.RecordBatch]:
        """Adds to the sums of the texts and to the pairs by history; the tokens that back off and the pairs' counts."""
        train = ~held[row]
        # Counts of the words that have no code: all their tokens are here.
        w = known.code(token)
        rare = np.flatnonzero(w < 0)
        words_here, word = np.unique(token[rare], return_inverse=True)
        own = np.bincount(word, weights=train[rare], minlength=len(words_here)).astype(np.int64)[word]
        count = known.count[w]
        count[rare] = own
        pair = pair_key(token, history)
        order = np.argsort(pair)
        first = np.flatnonzero(np.append(True, pair[order][1:] != pair[order][:-1]))
        seen = np.add.reduceat(train[order].astype(np.int64), first)
        r = np.empty(len(token), np.int64)
        r[order] = np.repeat(seen, np.diff(np.append(first, len(order))))
        log_p = known.log_p(count)
        fixed = np.where(r > CUTOFF, np.log10(np.maximum(r, 1)), 0) + np.where(r == 0, log_p, 0)
        sums[:, 0] += np.bincount(row[rare], weights=np.log10(own + 1.0), minlength=len(sums))
        sums[:, 1] += np.bincount(row, weights=fixed, minlength=len(sums))
        for k, which in enumerate([rare[own > 0], *[r == k for k in range(1, CUTOFF + 1)]]):
            counts[:, 1 + k] += np.bincount(row[which], minlength=len(counts)).astype(np.int32)
        none = np.flatnonzero(r == 0)
        if len(none):
            yield facts(BACKOFF, len(none), id_type, key=history[none].view(np.int64), uid=uid[row[none]], n0=np.ones(len(none), np.int32))
        kept = order[first][seen > 0]
        for a in range(0, len(kept), CHUNK):
            some = kept[a : a + CHUNK]
            ends = [0, len(some)]
            yield facts(PAIRS, 1, id_type, pairs=pa.ListArray.from_arrays(ends, pa.array(pair[some].view(np.int64))), counts=pa.ListArray.from_arrays(ends, pa.array(r[some].astype(np.int32))))
        histories.append((history[kept], 10.0 ** log_p[kept], np.minimum(r[kept], CUTOFF + 2).astype(np.int8)))

    return dealt.groupBy("part").applyInArrow(resolve, _FACTS_SCHEMA.format(kind=id_kind))


def _slice(block: list, known: Words, low: np.uint64, high: np.uint64 | None) -> tuple[np.ndarray, ...]:
    """Token, history and row of one block's tokens with hashes from low to high; slices are asked for in order."""
    tokens, at, codes, rares, rows, shift, done = block
    i, j = int(np.searchsorted(tokens, low)), len(tokens) if high is None else int(np.searchsorted(tokens, high))
    a, b = at[i], at[j]
    code = codes[a:b]
    rare = code == 0xFFFF
    history = known.coded[np.where(rare, 0, code)]
    block[6] = done + int(rare.sum())
    history[rare] = rares[done : block[6]]
    return np.repeat(tokens[i:j], np.diff(at[i : j + 1])), history, rows[a:b].astype(np.int32) + np.int32(shift)


def pair_key(token: np.ndarray, history: np.ndarray) -> np.ndarray:
    return mix(token * np.uint64(0xC2B2AE3D27D4EB4F) + history)


@dataclass
class Model:
    """The stored tables of a trained model: words (word, c), pairs (pair, c) and histories (history, c, weight)."""

    known: Words
    discount: np.ndarray
    words: DataFrame
    pairs: DataFrame
    histories: DataFrame

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id and ``score`` of every row of ``docs``, which needn't be training texts: each token is looked up in the tables."""
        kind = docs.schema[id_col].dataType.simpleString()

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(2))
                for a, b in steps(offsets, BLOCK_BYTES):
                    s = stream(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    row = pa.array(s.row + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(v.view(np.int64)) for v in (s.token, s.history, pair_key(s.token, s.history)))], ["uid", "id", "word", "history", "pair"])

        rows = _numbered(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), Scratch(docs.sparkSession, "katz-score"))
        tokens = rows.select("uid", "id", "text").mapInArrow(split, f"uid long, id {kind}, word long, history long, pair long")
        low = lambda c, d: F.when(c <= CUTOFF, c * F.element_at(F.array(*[F.lit(float(x)) for x in d]), F.least(c, F.lit(CUTOFF)).cast("int"))).otherwise(c)
        found = (
            tokens.join(self.pairs.select("pair", F.col("c").alias("c2")), "pair", "left")
            .join(self.histories.select("history", F.col("c").alias("ch"), "weight"), "history", "left")
            .join(self.words.select("word", F.col("c").alias("c1")), "word", "left")
        )
        k = self.known
        one = F.when(F.col("c1") > 0, low(F.col("c1"), k.discount) * (1 - k.spare) / max(k.total, 1)).otherwise(F.lit(float(k.unknown)))
        # The recursion: a pair's own probability where it was seen, else the history's weight and the shorter context.
        two = F.when(F.col("c2") > 0, F.log10(low(F.col("c2"), self.discount) / (F.col("ch") + 1))).otherwise(F.coalesce("weight", F.lit(0.0)) + F.log10(one))
        total = F.sum(two) if k.total else F.lit(0.0)
        return found.groupBy("uid").agg(F.max("id").alias(id_col), total.alias("score")).select(id_col, "score")


def _look_up_all(source: DataFrame, scratch: Scratch) -> tuple[Words, np.ndarray, DataFrame]:
    """What tasks know of words, the hot pairs' counts, and the facts of all parts as a table for each turn."""
    known = count_words(source, scratch)
    scratch.release()
    pairs = count_hot(source, known)
    parts = max(PARTS, -(-known.total // PART_TOKENS))
    facts = None
    for turn in range(TURNS):
        part = scratch.table(f"facts{turn}", look_up(deal(source, known, pairs, parts, turn), known))
        facts = part if facts is None else facts.unionByName(part)
        scratch.release()
    return known, pairs, facts


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows stored once with ``uid``: numbers worked out anew in a later job, or by a task that runs again behind a shuffle, may be others."""
    return scratch.table("numbered", rows.withColumn("uid", F.monotonically_increasing_id()))


def train_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> tuple[DataFrame, Model]:
    """The scores of every row of ``docs`` (see ``score_texts``), and the stored model of the rows that aren't held out.

    ``uid_col`` names a number that tells the rows apart and is the same in every job: a stored one, or a number by partition of files
    that are scanned as they are. Without one the rows are stored with a number first.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    source = docs.select(*([F.col(uid_col).alias("uid")] if uid_col else []), F.col(id_col).alias("id"), _held(held_out).alias("held"), F.coalesce(text_col, F.lit("")).alias("text"))
    source = source if uid_col else _numbered(source, scratch)
    with arrow_batches(spark, BATCH_BYTES), fixed_splits(spark):
        known, pairs, facts = _look_up_all(source, scratch)
    words = spark.read.schema("word long, c long").parquet(scratch.path("words"))

    # The pairs of hot words: their counts are known here, bounded by HOT squared.
    names = known.coded[np.argsort(np.where(known.hot >= 0, known.hot, HOT), kind="stable")[: (known.hot >= 0).sum()]]
    p = np.zeros(HOT)
    p[known.hot[known.hot >= 0]] = 10.0 ** known.log_p(known.count[known.hot >= 0])
    figures_schema = "key long, a double, " + ", ".join(f"n{k} int" for k in range(1, _COUNTS))
    rows = [(int(h.view(np.int64)), float(((pairs[k] > 0) * p).sum()), *[int((pairs[k] == r).sum()) for r in range(1, _COUNTS)]) for k, h in enumerate(names)]
    columns = ["key", "a", *[f"n{k}" for k in range(1, _COUNTS)]]
    figures = facts.filter(F.col("kind") == HISTORY).select(*columns).unionByName(spark.createDataFrame(rows, figures_schema))
    totals = figures.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(1, _COUNTS)]).first()
    d = discounts(list(totals))
    by_history = figures.groupBy("key").agg(F.sum("a").alias("a"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(1, CUTOFF + 1)])
    freed = sum((F.col(f"n{r}") * float((1 - d[r - 1]) * r) for r in range(1, CUTOFF + 1)), F.lit(1.0))
    # alpha(h) * (c(h) + 1): the factor c(h) + 1 is in the text's sum already.
    weight = scratch.table("weights", by_history.select("key", F.log10(freed / (1 - F.col("a"))).alias("weight")))
    backoff = facts.filter(F.col("kind") == BACKOFF).join(weight, "key", "left").groupBy("uid").agg(F.sum(F.col("n0") * F.coalesce("weight", F.lit(0.0))).alias("backoff"))
    sums = facts.filter(F.col("kind") == TEXT).groupBy("uid").agg(F.max("id").alias(id_col), F.max("held").alias("held_out"), *[F.sum(c).alias(c) for c in ("a", "b", *[f"n{k}" for k in range(_COUNTS)])])
    seen = sum((F.col(f"n{1 + r}") * float(np.log10(d[r - 1] * r)) for r in range(1, CUTOFF + 1)), F.col("b"))
    none = known.total == 0
    scored = sums.join(backoff, "uid", "left").select(
        id_col,
        "held_out",
        F.col("n0").cast("long").alias("n_tokens"),
        F.col("n1").cast("long").alias("n_known"),
        F.lit(int(known.total)).cast("long").alias("train_tokens"),
        (F.col("a") - F.col("n0") * float(np.log10(known.total + known.distinct + 1))).alias("base_score"),
        (F.lit(0.0) if none else seen + F.coalesce("backoff", F.lit(0.0)) - F.col("a")).alias("score"),
    )
    h, w = np.nonzero(pairs[: len(names), : len(names)])
    hot_rows = spark.createDataFrame(pa.table({"pair": pair_key(names[w], names[h]).view(np.int64), "c": pairs[h, w]}))
    counted = facts.filter(F.col("kind") == PAIRS).select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").cast("long").alias("c"))
    # The begin mark is counted as often as the end mark.
    ends = words.filter(F.col("word") == int(END.view(np.int64))).select(F.lit(int(BEGIN.view(np.int64))).alias("history"), "c")
    history = weight.join(words.select(F.col("word").alias("key"), "c"), "key").select(F.col("key").alias("history"), "c", (F.col("weight") - F.log10(F.col("c") + 1)).alias("weight"))
    begin = weight.join(ends, weight["key"] == ends["history"]).select("history", "c", (F.col("weight") - F.log10(F.col("c") + 1)).alias("weight"))
    return scored, Model(known, d, words, counted.union(hot_rows), history.union(begin))


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``docs``."""
    return train_and_score(docs, held_out, id_col, text_col, uid_col)[0]


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.monotonically_increasing_id().alias("uid"))
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, uid_col="uid")
