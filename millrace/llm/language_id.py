"""Language identification by nearest centroids.

A text is the TF-IDF vector of its hashed byte trigrams (letters lower-cased, everything else a space), sublinear in the
counts and of unit length. Every language keeps several centroids, found by spherical k-means over labelled texts; a text
gets the language of the centroid with the largest cosine. A text farther from all centroids of that language than all
but a few of its training texts is marked ``rejected``; the nearest language is still reported.

Document frequencies are counted over all labelled texts. Centroids are fitted on about ``MAX_SAMPLE`` of them, spread evenly over
the languages and chosen by a hash of the text, at least one of each language; whole texts are used. Every text is then scored
where it lies, without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0; without any labelled text everything is ``und``;
null labels don't teach; repeated rows are scored alike, and copies of a text teach centroids once; ids may have any type and be null
(not held out); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.words import steps, utf8

DIMS = 4096
CENTROIDS = 3
MAX_SAMPLE = 2400
STEP_ROWS = 512
SHARPNESS = 40.0

#: ASCII letters to lower case, other ASCII to a space, bytes above as they are.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def vectors(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Sublinear counts of the hashed trigrams, one row a text."""
    rows = len(offsets) - 1
    folded = _FOLD[data]
    if len(folded) > 1:  # capitals of the Latin-1 letters, two bytes in UTF-8
        second = (folded[:-1] == 0xC3) & (folded[1:] >= 0x80) & (folded[1:] <= 0x9E) & (folded[1:] != 0x97)
        folded[1:][second] += 32
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    if len(folded) < 3:
        return np.zeros((rows, dims), np.float32)
    code = (folded[:-2].astype(np.uint32) << np.uint32(16)) | (folded[1:-1].astype(np.uint32) << np.uint32(8)) | folded[2:]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - (dims.bit_length() - 1))).astype(np.int64)
    inside = (row[:-2] == row[2:]) & ~((folded[:-2] == 32) & (folded[1:-1] == 32))
    counts = np.bincount((row[:-2] * dims + slot)[inside], minlength=rows * dims).reshape(rows, dims)
    return np.log1p(counts.astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row a centroid
    owner: np.ndarray  # the language of each centroid
    least: np.ndarray  # the smallest accepted cosine of each language

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's index, the score and whether the text is rejected, for each row of counts."""
        cosine = _unit(x * self.idf) @ self.centroids.T
        best = np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        top = best.argmax(axis=1)
        share = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
        score = share[np.arange(len(top)), top] / share.sum(axis=1)
        return top, score, best[np.arange(len(top)), top] < self.least[top]


def fit(x: np.ndarray, labels: list[str], centroids: int = CENTROIDS, frequency: np.ndarray | None = None, texts: int = 0) -> Model:
    """Spherical k-means for each language; starts are the farthest-first texts, so the result is the same each time.

    ``frequency``: in how many of ``texts`` texts each trigram occurs; counted in ``x`` unless given.
    """
    languages = sorted(set(labels))
    if frequency is None:
        frequency, texts = (x > 0).sum(axis=0), len(x)
    idf = np.log((1 + texts) / (1 + frequency)).astype(np.float32) + 1
    unit, mine = _unit(x * idf), np.array([languages.index(v) for v in labels])
    out, owner, least = [], [], []
    for k in range(len(languages)):
        own = unit[mine == k]
        centres = _unit(own.mean(axis=0, keepdims=True))
        while len(centres) < min(centroids, len(own)):
            centres = np.vstack([centres, own[(own @ centres.T).max(axis=1).argmin()]])
        for _ in range(12):
            nearest = (own @ centres.T).argmax(axis=1)
            centres = _unit(np.stack([own[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))]))
        near = (own @ centres.T).max(axis=1)
        out.append(centres)
        owner += [k] * len(centres)
        least.append(float(np.quantile(near, 0.01)) * 0.8)
    return Model(languages, idf, np.vstack(out).astype(np.float32), np.array(owner), np.array(least))


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each trigram occurs, and the number of texts. ``texts``: one column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            total[DIMS] += batch.num_rows
            for a, b in _ranges(offsets):
                total[:DIMS] += (vectors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(total)], ["slot", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for r in texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        out[r["slot"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_sample: int = MAX_SAMPLE) -> Model | None:
    """A model from the rows of ``labelled`` with a text that has a letter and a language; None if there is none."""
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    usable = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit(17), text_col), F.lit(1 << 40)).alias("place"))
    # One row a language: how many texts, and the first by hash.
    by_language = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least"))
    languages = by_language.count()
    if not languages:
        return None
    limit = F.least(F.lit(1.0), F.lit(max_sample / languages) / F.col("n")) * (1 << 40)
    # Broadcast: it is far smaller than the model, which has centroids for each language and goes to every task.
    chosen = usable.join(F.broadcast(by_language), "lang").filter((F.col("place") < limit) | (F.col("place") == F.col("least")))
    once = chosen.groupBy("lang", "place").agg(F.min("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in _ranges(offsets):
                x = vectors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "x"])

    sample = sorted((r["lang"], bytes(r["x"])) for r in once.select("lang", "text").mapInArrow(encode, "lang string, x binary").collect())
    frequency, texts = frequencies(usable.select("text"))
    return fit(np.stack([np.frombuffer(x, np.float16).astype(np.float32) for _, x in sample]), [lang for lang, _ in sample], frequency=frequency, texts=texts)


def _ranges(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in steps(offsets):
        for k in range(a, b, STEP_ROWS):
            yield k, min(b, k + STEP_ROWS)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred``, ``score`` and ``rejected`` of every row of ``docs``."""
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    read = docs.select(F.col(id_col).alias(id_col), F.when(lettered, F.col(text_col)).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [*(model.languages if model else []), "und"]

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(batch.column(1).is_valid())
            data, offsets = utf8(batch.column(1))
            lang, score, far = np.full(len(known), len(names) - 1), np.zeros(len(known)), np.ones(len(known), bool)
            if model:
                for a, b in _ranges(offsets):
                    top, s, r = model.score(vectors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                    lang[a:b], score[a:b], far[a:b] = np.where(known[a:b], top, len(names) - 1), np.where(known[a:b], s, 0.0), r | ~known[a:b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names).take(pa.array(lang)), pa.array(score.astype(np.float64)), pa.array(far)], [id_col, "lang_pred", "score", "rejected"]
            )

    return read.mapInArrow(classify, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
