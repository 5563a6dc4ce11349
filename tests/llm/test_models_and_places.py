"""Piece models written by hand, and row numbers that are the same in every job."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import identity, katz, sentencepieces
from millrace.llm.words import utf8

UNIGRAM, BPE = 1, 2


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """A protocol buffer field: bytes, text, a float or a number."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def written(path, pieces, kind=UNIGRAM, prefix=1, collapse=0):
    """A model file of (piece, score) with the three control pieces and all bytes, without a normaliser."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, s, 1) for p, s in pieces]]
    model = b"".join(field(1, field(1, p) + field(2, float(s)) + field(3, t)) for p, s, t in rows)
    model += field(2, field(3, kind) + field(35, 1)) + field(3, field(1, "identity") + field(3, prefix) + field(4, collapse) + field(5, 1))
    path.write_bytes(model)
    return str(path)


#: Scores with many ties: two letters together cost as much as the letters alone, or less.
TIED = [("▁", -2.0), *[(c, -1.0) for c in "abcdé"], ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), ("cd", -1.5), ("▁a", -3.0), ("▁ab", -3.5), ("bcd", -2.5), ("dé", -1.25), ("aa", -2.0), ("aaa", -3.0)]


def test_unigram_ids_are_the_librarys(tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = written(tmp_path / "tied.model", TIED)
    sp, pieces, rng = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.load(path), random.Random(11)
    assert not pieces.bpe
    texts = ["".join(rng.choice("aabbccddé ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a" * 500, "abcd" * 100, "x漢 ab", ""]
    ids, at = sentencepieces.encode_block(*utf8(pa.array(texts)), pieces)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == sp.encode(t), t


def test_models_that_arent_supported_are_refused(tmp_path):
    pytest.importorskip("sentencepiece")
    for name, options in (("collapsing", {"collapse": 1}), ("no prefix", {"prefix": 0})):
        with pytest.raises(ValueError, match="aren't supported"):
            sentencepieces.load(written(tmp_path / f"{name}.model", TIED, **options))


def test_scans_are_split_alike(spark, tmp_path):
    """The splits don't follow the parallelism inside; the setting is as before afterwards."""
    name = "spark.sql.files.minPartitionNum"
    with identity.fixed_splits(spark):
        assert spark.conf.get(name) == str(spark.sparkContext.defaultParallelism)
        with identity.fixed_splits(spark):
            pass
        assert spark.conf.get(name) == str(spark.sparkContext.defaultParallelism)
    assert spark.conf.get(name, None) is None


def test_scores_by_place_equal_scores_of_stored_rows(spark, docs, folder):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    plain = lambda frame: sorted((tuple(r) for r in frame.collect()), key=repr)
    mine, stored = plain(katz.lm_query(spark, folder)), plain(katz.score_texts(docs, held))
    assert [m[:5] for m in mine] == [s[:5] for s in stored]
    assert [m[5:] for m in mine] == [pytest.approx(s[5:]) for s in stored]
