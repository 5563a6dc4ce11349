"""The pipeline, stage by stage."""

import corpus_pipeline
from millrace.session import Scratch


def test_stages(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left, scratch = docs.columns, docs.count(), Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(name, stage(spark, docs, folder))
        assert docs.count() <= left
        left = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {r.doc_id for r in docs.collect()}
    assert 5 not in ids  # it holds a benchmark item
    assert 0 in ids and not ids & set(range(60, 72))  # copies of 0
    assert docs.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and docs.filter("NOT round_trip").count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 20


def test_rows_without_their_own_id(spark, folder, corpus, tmp_path):
    """Null and repeated ids: items and copies go all the same, and of whole repeated rows one stays."""
    item = spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first().text
    own = [(None if k % 3 else k // 5, " ".join(f"{w}{k}" for w in corpus[k][1].split()), "en", "s0", k) for k in range(20)]
    rows = own + own[:6] + [(None, own[7][1], "fr", "s1", 1)] * 3 + [(None, own[8][1] + " " + item, "en", "s0", 2), (0, own[9][1] + " " + item, "en", "s0", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/d.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/d.parquet"), dict(corpus_pipeline.STAGES)
    one = stages["jaccard_join"](spark, docs, folder)
    assert one.columns == docs.columns
    texts = [r.text for r in one.collect()]
    assert len(texts) == len(set(texts)) and {t for t in texts if item not in t} >= {r[1] for r in own[:7]}
    clean = [r.text for r in stages["decontamination"](spark, docs, folder).collect()]
    assert sorted(clean) == sorted(r[1] for r in rows if item not in r[1])
