"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

Text is cut where no piece can reach across: before a run of spaces and around characters without a piece. Equal words are
encoded once a block, or once a task while ``MEMO_WORDS`` hold them, and words of equal length advance together: at each position the substrings that end there are looked
up by hash among the sorted piece hashes, the best last piece is a maximum over them, and its length is stored as the
backpointer. For a unigram model the maximised value is the sum of scores. A BPE model has no such sum, but its encoding is
the one path on which every two neighbouring pieces stay apart when encoded together; the pass then maximises over valid
neighbours, which leaves exactly one path: the ids are those of BPE. Whether two pieces stay apart is worked out from the
merges that form them, for all pairs of a step at once.

Words of more than ``EQUAL`` characters advance with others up to a fifth longer. A BPE word of more than ``STRIDE + OVERLAP`` characters
(a line of base64, text without spaces) is cut into stretches that overlap and advance together. Where two stretches have a
piece in common, the first's pieces up to it and the second's after it are again a path of valid neighbours, so the only one; where
they have none, the second starts anew at a seam of the first, and if that fails too the word is encoded in one go. A step takes
some 50 bytes for each of its at most ``ADVANCE`` characters.

Characters without a piece become byte pieces (or the unknown piece, in models without them). Decoding concatenates pieces, so
a text comes back whole, but for the sign that SentencePiece itself uses for a space, which comes back as a space.

Defined results: null stays null; an empty text has no ids; repeated rows are encoded alike; an empty table gives an empty
result; other columns are kept. The model file's path is a parameter; the driver reads it and sends its table along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.jaccard_join import ragged
from millrace.llm.words import mix, steps, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
BLOCK_BYTES = 4 << 20
#: Words of one length that advance together.
TOGETHER = 40_000
EQUAL, STRIDE, OVERLAP = 24, 240, 60
MEMO_WORDS = 400_000
#: Characters that are hashed at once, and words' characters that advance together.
AT_ONCE, ADVANCE = 500_000, 1_000_000
PAD = 0x110000
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    seq = np.full(max(n, 1), base, np.uint64)
    seq[0] = 1
    return np.cumprod(seq, dtype=np.uint64)


def _hash_rows(x: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of each row of code points; a substring's hash is a scaled difference."""
    out = np.zeros((x.shape[0], x.shape[1] + 1), np.uint64)
    for k in range(0, len(x), AT_ONCE // x.shape[1] + 1):
        some = x[k : k + AT_ONCE // x.shape[1] + 1]
        np.cumsum(mix(some.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, x.shape[1]), axis=1, out=out[k : k + len(some), 1:])
    return out


def _word_hashes(c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word; whole words of AT_ONCE characters together, or one longer word, go at once."""
    out = np.zeros(len(begin), np.uint64)
    low = 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(end, begin[low] + AT_ONCE, "right")))
        first, last = int(begin[low]), int(end[high - 1])
        sums = np.zeros(last - first + 1, np.uint64)
        ahead = _powers(_BASE, last - first)
        np.cumsum(mix(c[first:last].astype(np.uint64) + np.uint64(1)) * ahead, out=sums[1:])
        b, e = begin[low:high] - first, end[low:high] - first
        out[low:high] = mix((sums[e] - sums[b]) * _powers(_INVERSE, last - first + 1)[b] + (e - b).astype(np.uint64))
        low = high
    return out


@dataclass
class Pieces:
    """The vocabulary as arrays. Ranks order merges; characters have rank -1."""

    bpe: bool
    hash: np.ndarray  # ascending hashes of the pieces that text can match
    id: np.ndarray  # their ids
    score: np.ndarray  # by id
    rank: np.ndarray  # by id
    left: np.ndarray  # by id: the two pieces merged last, or the piece itself
    right: np.ndarray
    longest: int
    length: np.ndarray  # characters, by id
    known: np.ndarray  # by code point
    byte: np.ndarray  # ids of the byte pieces, or the unknown piece's
    space_runs: list[list[int]]  # ids of runs of 0, 1, 2 .. spaces, up to the longest
    text: np.ndarray  # bytes of all pieces as decoded
    text_at: np.ndarray
    maybe: np.ndarray = field(default_factory=lambda: np.ones(1 << 20, bool))  # by the first 20 bits of a hash: whether a piece has them
    joined: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes of id pairs whose concatenation is a piece
    joined_rank: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
        hit = self.hash[at] == h[some]
        out[some[hit]] = self.id[at[hit]]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay two pieces when their concatenation is encoded.

        The last merges are undone, the later first; a piece over the seam would have been made if its rank comes before
        the merge that used up one of the two pieces at the seam. Of equal merges the left one comes first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = mix(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64))
            at = np.minimum(np.searchsorted(self.joined, key), max(len(self.joined) - 1, 0))
            over = (self.joined[at] == key) & (self.joined_rank[at] < limit[live]) if len(self.joined) else np.zeros(len(live), bool)
            out[live[over]] = False
            rx, ry = self.rank[x], self.rank[y]
            ends = over | ((rx < 0) & (ry < 0))
            first = rx > ry
            limit[live] = np.where(first, rx, ry + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
            live = live[~ends]
        return out


    def run(self, k: int) -> list[int]:
        """The ids of k spaces."""
        known = len(self.space_runs) - 1
        if k <= known:
            return self.space_runs[k]
        period = known // 2
        times = (k - period) // period
        return self.space_runs[period] * times + self.space_runs[k - period * times]

    def spell(self, point: int) -> list[int]:
        """The ids of a character without a piece."""
        return [int(self.byte[0])] if self.byte[0] == self.byte[1] else [int(self.byte[b]) for b in chr(point).encode()]


def load(path: str = MODEL) -> Pieces:
    """The vocabulary of a model file; read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names, score = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    by_name = {names[i]: i for i in plain}
    blank = chr(SPACE)
    spaces = {len(names[i]) for i in plain if not names[i].strip(blank)}
    letters = [i for i in plain if names[i].strip(blank) or names[i] == blank]
    # Scores of a BPE model are minus the merge's number; those of a unigram model are log probabilities.
    merges = sorted((i for i in letters if len(names[i]) > 1), key=lambda i: -score[i])
    bpe = all(score[i] == round(score[i]) for i in merges) and len({score[i] for i in merges}) == len(merges)
    rank = np.full(n, -1, np.int64)
    rank[merges] = np.arange(len(merges))
    left = right = np.arange(n)
    if bpe:
        left, right, letters = _last_merges(names, by_name, rank, letters)
    longest = max((len(names[i]) for i in letters), default=1)
    by_length: dict[int, list[int]] = {}
    for i in letters:
        by_length.setdefault(len(names[i]), []).append(i)
    hashed = {}
    for size, ids in by_length.items():
        points = np.array([[ord(c) for c in names[i]] for i in ids], np.int64)
        hashed.update(zip(_hash_rows(points)[:, -1].tolist(), ids, strict=True))
    order = sorted(hashed)
    known = np.zeros(0x110000, bool)
    known[[ord(names[i]) for i in letters if len(names[i]) == 1]] = True
    known[SPACE] = True
    byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    raw = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else names[i].replace(blank, " ").encode() for i in range(n)]
    out = Pieces(bpe, np.array(order, np.uint64), np.array([hashed[h] for h in order], np.int32), score, rank, left, right, longest, np.array([len(x) for x in names]), known, byte, [], np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    out.maybe[:] = False
    out.maybe[(out.hash >> np.uint64(44)).astype(np.int64)] = True
    # Runs of spaces score alike, so the library itself tells how they are cut; from the largest piece on that repeats.
    out.space_runs = [[], sp.encode(" ")[:1] if 1 not in spaces else [by_name[blank]], *[sp.encode(" " * k) for k in range(1, 2 * max(spaces, default=1))]]
    if bpe:
        usable = set(letters)
        pairs = {}
        for i in letters:
            for cut in range(1, len(names[i])):
                a, b = by_name.get(names[i][:cut]), by_name.get(names[i][cut:])
                if a in usable and b in usable:
                    pairs[int(mix(np.array([a << 32 | b], np.uint64))[0])] = int(rank[i])
        out.joined = np.array(sorted(pairs), np.uint64)
        out.joined_rank = np.array([pairs[h] for h in out.joined.tolist()], np.int64)
    _supported(out, sp, path)
    return out


def _supported(pieces: Pieces, sp, path: str) -> None:
    """An error for a model whose normaliser changes texts, that collapses white space, puts no space before texts or spells no bytes."""
    probes = ["a", " a", "a b", "a  b  ", "\t\n", "\uff21\uff22", "\ufb01", "e\u0301", "\u00a0x", "\u00bd", "\U0001f600", "\u2581"]
    raw = [p.encode() for p in probes]
    ids, at = encode_block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), pieces)
    for k, probe in enumerate(probes):
        if sp.encode(probe) != ids[at[k] : at[k + 1]].tolist():
            raise ValueError(f"{path}: the model's ids of {probe!r} need a normaliser or options that aren't supported here")


def _last_merges(names: list[str], by_name: dict[str, int], rank: np.ndarray, letters: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The two pieces merged last into each piece, and the pieces that merging can make."""
    left, right, made = np.arange(len(names)), np.arange(len(names)), []
    for i in letters:
        parts = [by_name.get(c, -1) for c in names[i]]
        last = None
        while len(parts) > 1:
            options = [(rank[j], k) for k in range(len(parts) - 1) if parts[k] >= 0 and parts[k + 1] >= 0 and (j := by_name.get(names[parts[k]] + names[parts[k + 1]], -1)) >= 0 and rank[j] >= 0]
            if not options:
                break
            k = min(options)[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [by_name[names[parts[k]] + names[parts[k + 1]]]]
        if parts == [i]:
            made.append(i)
            left[i], right[i] = last or (i, i)
    return left, right, made


def encode_words(x: np.ndarray, pieces: Pieces, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each row of code points, all of known characters, and how many: a matrix filled from the right.

    ``lengths``: of the rows, where those that end earlier are filled up with PAD.
    """
    rows, length = x.shape
    sums, back_power = _hash_rows(x), _powers(_INVERSE, length + 1)
    last = np.full((rows, length + 1), -1, np.int32)  # the last piece of the best path to each position
    size = np.zeros((rows, length + 1), np.int16)
    best = np.full((rows, length + 1), -np.inf, np.float32)
    best[:, 0] = 0
    for end in range(1, length + 1):
        for span in range(1, min(pieces.longest, end) + 1):
            begin = end - span
            found = pieces.find((sums[:, end] - sums[:, begin]) * back_power[begin])
            some = np.flatnonzero((found >= 0) & (best[:, begin] > -np.inf))
            if not len(some):
                continue
            value = (best[some, begin] + pieces.score[found[some]]).astype(np.float32) if not pieces.bpe else np.zeros(len(some))
            if pieces.bpe and begin:
                packed, at = np.unique(last[some, begin].astype(np.int64) << 32 | found[some], return_inverse=True)
                value[~pieces.apart(packed >> 32, packed & 0xFFFFFFFF)[at]] = -np.inf
            # Of equal sums the one with the longer last piece stays.
            better = value > best[some, end] if pieces.bpe else value >= best[some, end]
            some = some[better]
            best[some, end], last[some, end], size[some, end] = value[better], found[some], span
    ids, count, at = np.zeros((rows, length), np.int32), np.zeros(rows, np.int64), np.full(rows, length) if lengths is None else lengths.copy()
    live = np.arange(rows)
    while len(live):
        count[live] += 1
        ids[live, length - count[live]] = last[live, at[live]]
        at[live] -= size[live, at[live]]
        live = live[at[live] > 0]
    return ids, count


def encode_spans(c: np.ndarray, begin: np.ndarray, size: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the stretches of ``c`` that begin there and have these sizes: one pool of ids, each stretch's place in it, and count."""
    made, count = [np.zeros(0, np.int32)], np.zeros(len(begin), np.int64)
    at, total = np.zeros(len(begin), np.int64), 0
    # Equal sizes up to EQUAL, then classes of sizes.
    group = np.where(size <= EQUAL, size, EQUAL + 1 + np.floor(np.log(np.maximum(size, 1) / EQUAL) / np.log(1.2)).astype(np.int64))
    for g in np.unique(group):
        same = np.flatnonzero(group == g)
        widest = int(size[same].max())
        step = max(1, min(TOGETHER, ADVANCE // widest))
        for k in range(0, len(same), step):
            some = same[k : k + step]
            place = begin[some][:, None] + np.arange(widest)
            inside = np.arange(widest) < size[some][:, None]
            x = np.where(inside, c[np.minimum(place, len(c) - 1)], PAD)
            ids, n = encode_words(x, pieces, size[some])
            flat = ids[np.arange(widest)[None, :] >= widest - n[:, None]]
            made.append(flat)
            count[some], at[some] = n, total + np.cumsum(n) - n
            total += len(flat)
    return np.concatenate(made), at, count


def _joined(c: np.ndarray, begin: int, end: int, starts: np.ndarray, parts: list[np.ndarray], pieces: Pieces) -> np.ndarray:
    """The ids of one long word from those of its overlapping stretches."""

    def seams(start: int, ids: np.ndarray) -> np.ndarray:
        return start + np.cumsum(pieces.length[ids]) - pieces.length[ids]

    def meet(path: np.ndarray, seam: np.ndarray, more: np.ndarray, more_seam: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        first = int(np.searchsorted(seam, more_seam[0]))
        common, i, j = np.intersect1d(seam[first:] << 32 | path[first:], more_seam << 32 | more, assume_unique=True, return_indices=True)
        if not len(common):
            return None
        i, j = first + int(i[0]) + 1, int(j[0]) + 1
        return np.concatenate([path[:i], more[j:]]), np.concatenate([seam[:i], more_seam[j:]])

    done_ids, done = [], 0
    path, seam = parts[0].astype(np.int64), seams(begin, parts[0])
    for start, ids in zip(starts[1:].tolist(), parts[1:], strict=True):
        # What lies well before the next stretch is settled.
        settled = int(np.searchsorted(seam, start - OVERLAP))
        done_ids.append(path[:settled])
        path, seam = path[settled:], seam[settled:]
        stop = start + int(pieces.length[ids].sum())
        found = meet(path, seam, ids.astype(np.int64), seams(start, ids))
        if found is None:
            again = int(seam[min(int(np.searchsorted(seam, start)), len(seam) - 1)])
            pool, at, n = encode_spans(c, np.array([again]), np.array([stop - again]), pieces)
            found = meet(path, seam, pool.astype(np.int64), seams(again, pool))
        if found is None:
            return encode_spans(c, np.array([begin]), np.array([end - begin]), pieces)[0]
        path, seam = found
    return np.concatenate([*done_ids, path]).astype(np.int32)


def encode_all(c: np.ndarray, begin: np.ndarray, size: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``encode_spans``, with long words in stretches."""
    long = np.flatnonzero(size > STRIDE + OVERLAP) if pieces.bpe else np.zeros(0, np.int64)
    if not len(long):
        return encode_spans(c, begin, size, pieces)
    parts = -(-(size[long] - OVERLAP) // STRIDE)
    word = np.repeat(np.arange(len(long)), parts)
    start = begin[long][word] + STRIDE * (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(start + STRIDE + OVERLAP, (begin + size)[long][word])
    short = np.flatnonzero(size <= STRIDE + OVERLAP)
    pool, at, count = encode_spans(c, np.concatenate([begin[short], start]), np.concatenate([size[short], stop - start]), pieces)
    out_at, out_count, more, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), [pool], len(pool)
    out_at[short], out_count[short] = at[: len(short)], count[: len(short)]
    first = len(short) + np.cumsum(parts) - parts
    for k, which in enumerate(long.tolist()):
        mine = range(int(first[k]), int(first[k] + parts[k]))
        ids = _joined(c, int(begin[which]), int(begin[which] + size[which]), start[first[k] - len(short) : first[k] - len(short) + parts[k]], [pool[at[m] : at[m] + count[m]] for m in mine], pieces)
        out_at[which], out_count[which] = total, len(ids)
        more.append(ids)
        total += len(ids)
    return np.concatenate(more), out_at, out_count


class Memo:
    """Words of earlier blocks of a task with their ids; started anew when it holds more than ``MEMO_WORDS``."""

    def __init__(self) -> None:
        self.hash, self.at, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, h: np.ndarray, c: np.ndarray, begin: np.ndarray, size: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode_all`` for words with the ascending hashes ``h``."""
        if len(self.hash) > MEMO_WORDS:
            self.__init__()
        place = np.searchsorted(self.hash, h)
        known = np.zeros(len(h), bool)
        inside = place < len(self.hash)
        known[inside] = self.hash[place[inside]] == h[inside]
        new = np.flatnonzero(~known)
        pool, at, count = encode_all(c, begin[new], size[new], pieces)
        self.at, self.count = (np.insert(old, place[new], more) for old, more in ((self.at, at + len(self.pool)), (self.count, count)))
        self.hash, self.pool = np.insert(self.hash, place[new], h[new]), np.concatenate([self.pool, pool])
        mine = np.searchsorted(self.hash, h)
        return self.pool, self.at[mine], self.count[mine]


def encode_block(data: np.ndarray, offsets: np.ndarray, pieces: Pieces, memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and the offsets of each row's."""
    rows = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    filled = np.flatnonzero(np.diff(first) > 0)
    # A space goes before each text that isn't empty.
    c = np.insert(points, first[filled], SPACE)
    del points
    c[c == 32] = SPACE
    start_of = first + np.searchsorted(filled, np.arange(rows + 1))
    if not len(c):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    space, unknown = c == SPACE, ~pieces.known[c]
    cut = np.zeros(len(c), bool)
    cut[start_of[:-1][np.diff(start_of) > 0]] = True
    cut[0] = True
    cut |= unknown
    cut[1:] |= unknown[:-1] | (space[1:] & ~space[:-1])
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(c))
    spaces = np.add.reduceat(space, begin)
    wordy = (end - begin > spaces) & ~unknown[begin]
    word_begin, word_end = begin[wordy] + np.maximum(spaces[wordy] - 1, 0), end[wordy]

    # Equal words once.
    h = _word_hashes(c, word_begin, word_end)
    different, example, word = np.unique(h, return_index=True, return_inverse=True)
    length = word_end[example] - word_begin[example]
    pool, made_at, made_count = (memo or Memo()).encode(different, c, word_begin[example], length, pieces)

    # A run of spaces before a word leaves its last one to the word, unless the word's first piece is that space alone.
    lone = np.zeros(len(begin), bool)
    lone[wordy] = (spaces[wordy] > 0) & (pool[made_at[word]] == pieces.space_runs[1][0])
    in_run = spaces - (wordy & (spaces > 0)).astype(np.int64)
    first_part = np.where(lone, in_run + 1, in_run)
    runs = [pieces.run(k) for k in range(int(first_part.max()) + 1)] if first_part.max() < 4096 else None
    if runs is None:  # very long runs: only the lengths that occur
        sizes, first_part = np.unique(first_part, return_inverse=True)
        runs = [pieces.run(int(k)) for k in sizes]
    run_count = np.array([len(r) for r in runs], np.int64)
    run_at = np.cumsum(run_count) - run_count
    characters, which = np.unique(c[begin[unknown[begin]]], return_inverse=True)
    spelled = [pieces.spell(int(u)) for u in characters]
    spell_count = np.array([len(r) for r in spelled], np.int64)
    spell_at = np.cumsum(spell_count) - spell_count
    every = np.concatenate([pool, np.array([i for r in runs for i in r], np.int32), np.array([i for r in spelled for i in r], np.int32)])
    at, count = np.zeros((len(begin), 2), np.int64), np.zeros((len(begin), 2), np.int64)
    at[:, 0], count[:, 0] = len(pool) + run_at[first_part], run_count[first_part]
    at[wordy, 1], count[wordy, 1] = made_at[word] + lone[wordy], made_count[word] - lone[wordy]
    strange = unknown[begin]
    at[strange, 1], count[strange, 1] = len(pool) + run_count.sum() + spell_at[which], spell_count[which]
    ids = every[ragged(at.ravel(), count.ravel())]
    before = np.concatenate([[0], np.cumsum(count.sum(axis=1))])
    return ids, before[np.searchsorted(begin, start_of)]


def decode_block(ids: np.ndarray, at: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows of ids, and the offsets of each row's."""
    begin, size = pieces.text_at[ids], pieces.text_at[ids + 1] - pieces.text_at[ids]
    data = pieces.text[ragged(begin, size)]
    offsets = np.concatenate([[0], np.cumsum(size)])[at]
    full = np.flatnonzero(np.diff(offsets) > 0)
    leading = full[data[offsets[full]] == 32]
    keep = np.ones(len(data), bool)
    keep[offsets[leading]] = False
    return data[keep], offsets - np.searchsorted(leading, np.arange(len(offsets)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id, ``ids``, ``n_tokens`` and ``round_trip`` (whether decoding gives the text back) of every row of ``docs``."""
    pieces, kind = load(model), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            missing = np.asarray(batch.column(1).is_null())
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets, BLOCK_BYTES):
                own, own_at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, at = encode_block(own, own_at, pieces, memo)
                back, back_at = decode_block(ids, at, pieces)
                if np.array_equal(back_at, own_at) and np.array_equal(back, own):
                    same = np.ones(b - a, bool)
                else:
                    same = np.array([np.array_equal(back[back_at[k] : back_at[k + 1]], own[own_at[k] : own_at[k + 1]]) for k in range(b - a)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(missing[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists, pa.array(np.diff(at)), pa.array(same)], [id_col, "ids", "n_tokens", "round_trip"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id and ``text`` of every row of ids; null ids give null."""
    pieces, kind = load(model), encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            counts = np.where(np.asarray(ids.is_null()), 0, np.asarray(ids.value_lengths().fill_null(0)))
            data, at = decode_block(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]), pieces)
            raw = data.tobytes()
            texts = [None if none else raw[at[k] : at[k + 1]].decode("utf-8", "replace") for k, none in enumerate(np.asarray(ids.is_null()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def encode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ``ids``, ``n_tokens`` and ``round_trip`` of every document."""
    return encode(docs)
