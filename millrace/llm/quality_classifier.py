"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words, all of its text. Every passage is encoded (character classes, word
statistics and hashed byte pairs, through a dense layer), gated attention learnt from document labels weighs the passages, and
the weighted mean is scored. Training: gradient descent on all passages of labelled documents of at most ``MAX_SAMPLE`` different
ids, chosen by a hash of the id and taken in the hash's order; a document whose passages would make the sample larger than
``MAX_PASSAGES`` passages is left out. Scoring: every passage of every document, where it lies, without a shuffle. A passage's
features come from its own words alone, so a text scores the same in any batch.

Defined results: a null or empty text is one passage without words; without labels each score is 0.5, with labels of one kind
that kind's value; null labels and null ids don't teach, of several labels of a document the largest counts, of several texts of
one id the one with the least hash teaches; repeated rows are scored alike; an empty table gives an empty result; other columns
aren't read; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.words import LOWER, SPACE, hashes, mix, ngrams, steps, utf8, words
from millrace.session import Scratch

PASSAGE_WORDS = 64
PAIRS = 256
MAX_SAMPLE, MAX_PASSAGES = 4000, 60_000
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 24, 64, 0.004, 1e-4
ACCEPT = 0.7

#: Classes of bytes: their shares are the first statistics of a passage.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[SPACE] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in "#*$%&<>"]] = 6
_CLASS[ord("|")] = 7
_CLASS[ord("!")] = 8
_CLASS[[ord(c) for c in ",."]] = 9
_CLASS[128:] = 10
CLASSES = 11
WIDTH = CLASSES + 4 + PAIRS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of each passage and the offsets of each row's passages."""
    starts, ends, word_at = words(data, offsets)
    counts = np.diff(word_at)
    parts = np.maximum(1, -(-counts // PASSAGE_WORDS))
    part_at = np.concatenate([[0], np.cumsum(parts)])
    total = int(part_at[-1])
    doc = np.repeat(np.arange(len(parts)), parts)
    within = np.arange(total) - part_at[doc]
    first = np.minimum(word_at[doc] + PASSAGE_WORDS * within, max(len(starts) - 1, 0))
    begin = np.where(within == 0, offsets[doc], starts[first] if len(starts) else 0)
    length = np.diff(np.append(begin, len(data)))
    of_byte = np.repeat(np.arange(total), length)
    kinds = np.bincount(of_byte * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES) / np.maximum(length, 1)[:, None]
    word_doc = np.repeat(np.arange(len(counts)), counts)
    of_word = part_at[word_doc] + (np.arange(len(starts)) - word_at[word_doc]) // PASSAGE_WORDS
    n_words = np.bincount(of_word, minlength=total)
    chars = np.bincount(of_word, weights=ends - starts, minlength=total)
    h = hashes(data, starts, ends)
    distinct = _distinct(of_word, h, total)
    # Windows that lie whole in a passage.
    inside = of_word[:-2] == of_word[2:]
    triples = _distinct(of_word[:-2][inside], ngrams(h, 3)[inside], total)
    stats = np.stack([np.log1p(n_words), chars / np.maximum(n_words, 1), distinct / np.maximum(n_words, 1), triples / np.maximum(n_words, 1)], axis=1)
    folded = LOWER[data].astype(np.int64)
    slot = ((folded[:-1] * 0x9E37 + folded[1:] * 0x85EB) >> 3) % PAIRS
    same = of_byte[:-1] == of_byte[1:]
    pairs = np.bincount((of_byte[:-1] * PAIRS + slot)[same], minlength=total * PAIRS).reshape(total, PAIRS)
    return np.concatenate([kinds, stats, np.sqrt(pairs / np.maximum(length, 1)[:, None])], axis=1).astype(np.float32), part_at


def _distinct(part: np.ndarray, h: np.ndarray, total: int) -> np.ndarray:
    """How many distinct hashes each passage has."""
    packed = np.unique((part.astype(np.uint64) << np.uint64(40)) | (mix(h) >> np.uint64(24)))
    return np.bincount((packed >> np.uint64(40)).astype(np.int64), minlength=total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The score of each bag; ``at`` holds the offsets of its passages."""
        return _forward(self.weights, (x - self.mean) * self.scale, at)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(at) - 1), np.diff(at))
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    t, s = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
    e = (t * s) @ w["attend"]
    a = np.exp(e - np.maximum.reduceat(e, at[:-1])[bag])
    a /= np.add.reduceat(a, at[:-1])[bag]
    z = np.add.reduceat(h * a[:, None], at[:-1], axis=0)
    return {"bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out_bias"])}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, at)
    h, t, s, a, bag = f["h"], f["t"], f["s"], f["a"], f["bag"]
    do = (f["p"] - y) / len(y)
    dz = do[:, None] * w["out"]
    da = (h * dz[bag]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, at[:-1])[bag])
    dg = de[:, None] * w["attend"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = (a[:, None] * dz[bag] + dt @ w["value"].T + ds @ w["gate"].T) * (1 - h * h)
    return {
        "encode": x.T @ dh,
        "encode_bias": dh.sum(axis=0),
        "value": h.T @ dt,
        "gate": h.T @ ds,
        "attend": (t * s).T @ de,
        "out": f["z"].T @ do,
        "out_bias": do.sum(keepdims=True),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam on the log loss of whole bags."""
    rng = np.random.Generator(np.random.PCG64(7))
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), 1 / np.maximum(every.std(axis=0), 1e-3)
    bags = [np.clip((b - mean) * scale, -8, 8) for b in bags]
    shapes = {"encode": (WIDTH, HIDDEN), "encode_bias": (HIDDEN,), "value": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attend": (GATE,), "out": (HIDDEN,), "out_bias": (1,)}
    w = {k: (rng.standard_normal(v) / np.sqrt(v[0]) if "bias" not in k else np.zeros(v)).astype(np.float32) for k, v in shapes.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            at = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
            g = _gradient(w, np.concatenate([bags[i] for i in some]), at, labels[some])
            step += 1
            for name in w:
                grad = g[name] + DECAY * w[name]
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad * grad
                pace = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                w[name] = (w[name] - pace * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
    return Model(mean.astype(np.float32), scale.astype(np.float32), w)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_sample: int = MAX_SAMPLE) -> Model | float:
    """A model from the labelled documents, or the one score that labels of one kind, or none, allow."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    n = known.count()
    if not n:
        return 0.5
    # At most about max_sample ids, so this side is small enough to broadcast.
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(29), id_col), F.lit(1 << 40)) < min(1.0, max_sample / n) * (1 << 40))
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col, "_y").agg(F.min(F.struct(F.xxhash64(text_col), text_col)).alias("_t"))
    rows = texts.select(F.xxhash64(F.lit(31), id_col), F.col(id_col).cast("string"), "_y", F.col(f"_t.{text_col}"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for a, b in steps(offsets):
                x, at = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = [x[at[k] : at[k + 1]].astype(np.float16).tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(3)), pa.array(np.diff(at)), pa.array(some, pa.binary())], ["place", "id", "y", "parts", "x"])

    sample = Scratch(docs.sparkSession, "classifier").table("sample", rows.mapInArrow(encode, "place long, id string, y int, parts long, x binary"))
    total, taken = 0, []
    for r in sorted(sample.select("place", "id", "parts").collect()):
        if total + r["parts"] <= MAX_PASSAGES:
            total += r["parts"]
            taken.append(r["id"])
    bags = sorted(sample.filter(F.col("id").isin(taken)).select("place", "id", "y", "x").collect()) if taken else []
    y = np.array([min(max(r["y"], 0), 1) for r in bags], np.float32)
    if not len(y):
        return 0.5
    if y.min() == y.max():
        return float(y[0])
    return fit([np.frombuffer(r["x"], np.float16).astype(np.float32).reshape(-1, WIDTH) for r in bags], y)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` of every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets) if isinstance(model, Model) else ():
                x, at = passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out[a:b] = model.score(x, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(apply, f"`{id_col}` {kind}, score double")


def classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs, labels.filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
