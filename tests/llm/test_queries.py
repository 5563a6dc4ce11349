"""Every registered query runs over tables with nulls, empty texts and copies, and returns its contract's columns."""

import duckdb
import pytest

from millrace.llm import queries as q

COLUMNS = {
    "op1": ["page_id", "host", "path", "rule", "verdict"],
    "op2": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op4": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5": ["doc_id", "ids", "n_tokens", "round_trip"],
    "op6": ["doc_id", "held_out", "lang_pred", "score"],
    "op7": ["doc_id", "item_id"],
    "op8": ["doc_id", "n_shingles", "component_id"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op11": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op13": ["lang", "source", "part", "item", "value", "rank"],
}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_runs(spark, folder, corpus, name):
    frame = q.queries()[name](spark, folder)
    wanted = COLUMNS[name.split("_")[0]]
    assert frame.columns[: len(wanted)] == wanted
    rows = frame.collect()
    if name.startswith("op7"):
        assert {(r.doc_id, r.item_id) for r in rows} == {(5, 1)}
    elif name.startswith("op13"):
        assert {(r.lang, r.source) for r in rows} == {(r[2] or "", r[3] or "") for r in corpus}
    elif name.startswith("op1_"):
        assert len(rows) == 221 and {r.verdict for r in rows} == {"allow", "block"}
    else:
        assert sorted(r.doc_id for r in rows) == [r[0] for r in corpus]


def test_sql_is_text():
    sql = q.oracle_sql()
    assert set(sql) <= set(q.queries()) and all(isinstance(text, str) for text in sql.values())


def test_audit_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(q.oracle_sql()["op13_source_divergence"])
    columns, want = want.columns, sorted(want.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in q.queries()["op13_source_divergence"](spark, folder).collect()) == want


def test_jaccard_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    want = sorted(con.sql(q.oracle_sql()["op8_heavy_light_jaccard"]).fetchall())
    got = q.queries()["op8_heavy_light_jaccard"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len({r.component_id for r in got}) <= len(got) - 15


@pytest.fixture(scope="module")
def odd_folder(spark, corpus, tmp_path_factory):
    """Tables in which ids are null or repeated and whole rows occur twice."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(None if k % 7 == 0 else k // 2, *r[1:5]) for k, r in enumerate(corpus)]
    spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (3, 1, 0), (3, 0, None), (4, None, 1), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, corpus[5][1][:200]), (1, None), (1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(None, "http://a.com/en/1", None)] * 3 + [(1, None, None), (1, "http://b.net/de/1", "x")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, len(rows) + 20


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_odd_ids(spark, odd_folder, name):
    """Null and repeated ids: every row has its result, and whether a row is held out is always known."""
    folder, n = odd_folder
    rows = q.queries()[name](spark, folder).collect()
    if name.startswith("op1_"):
        assert len(rows) == 5 and all(r.verdict in ("allow", "block") for r in rows)
    elif not name.startswith(("op7", "op13")):
        assert len(rows) == n and sum(r.doc_id is None for r in rows) == sum(k % 7 == 0 for k in range(n - 20)) + sum(k % 7 == 0 for k in range(20))
        assert all(r.held_out in (True, False) for r in rows if "held_out" in r)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, tmp_path, name):
    for table, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert q.queries()[name](spark, str(tmp_path)).collect() == []
