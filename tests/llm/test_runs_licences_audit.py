"""Periodic runs, licence scans and the source audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from millrace.llm import license_scan, periodic_runs, source_audit

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, shortest=6, times=4):
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            run = w[start : start + length]
            if i > start and length >= max(shortest, times * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                found.add((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repeating(rng):
    """Word lists with runs of all kinds: random over few words, periodic with noise around, Fibonacci words, one word."""
    n, kind = rng.randint(0, 60), rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(n)]
    if kind < 0.7:
        period = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        noise = lambda: [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
        return (noise() + [period[i % len(period)] for i in range(n)] + noise()) * rng.randint(1, 2)
    if kind < 0.8:
        w = ["a"]
        while len(w) < n:
            w = [y for x in w for y in (["a", "b"] if x == "a" else ["a"])]
        return w
    return ["a"] * n if kind < 0.9 else [rng.choice(["x", "yy", "zé", "qqq"]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_refinement_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        lists = [repeating(rng) for _ in range(rng.randint(1, 10))]
        runs, texts = periodic_runs._batch(pa.array([None if not w else "\n" + "  ".join(w) for w in lists], pa.string()), 6, 4)
        for w, found, text in zip(lists, runs.to_pylist(), texts.to_pylist(), strict=True):
            want = brute_runs(w)
            assert [(r["start"], r["length"], r["period"]) for r in found] == want
            assert text.decode() == collapsed(w, want)


def test_long_periods():
    rng = random.Random(3)
    period = [f"w{rng.randrange(999)}" for _ in range(20_000)]
    runs, _ = periodic_runs._batch(pa.array([" ".join(["x", *period * 4]), "a " * 100_000]), 6, 4)
    assert [[tuple(r.values()) for r in x] for x in runs.to_pylist()] == [[(1, 80_000, 20_000)], [(0, 100_000, 1)]]


def planted(doc_id, text):
    w = words(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, folder, corpus):
    got = {r.doc_id: r for r in periodic_runs.runs_query(spark, folder).collect()}
    many = 0
    for doc_id, text, *_ in corpus:
        w = planted(doc_id, text)
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        many += bool(runs)
    assert many >= 5


def test_runs_keep_other_columns(spark, nothing):
    rows = [(None, "a b a b a b a b", "old", 1), (1, None, None, None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, runs string, `odd name` int")
    got = periodic_runs.find_runs(docs).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"doc_id", "odd name", "runs", "collapsed"}
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 8, 2)], []] * 2 and bytes(got[0].collapsed) == b"a b" and bytes(got[1].collapsed) == b""
    assert periodic_runs.find_runs(nothing).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, times=1)


# Licences


def base_of(text):
    w, starts, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)), [], set()
    for phrase, label in license_scan.PHRASES:
        phrase = phrase.split()
        here = [i for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
        starts += here
        labels |= {label} if here else set()
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


MIT = license_scan.TEMPLATES[0].text
TEXTS = [
    ("Released under the MIT License.", "mit"),
    ("under the mit license under the mit license, apache license version 2", "apache-2,mit"),
    ("under the\x00MIT\x7flicense", "mit"),
    ("under the mité license cc-by-nc", "cc-by-nc"),
    ("cc by sa nc", ""),
    ("Intro.\n" + MIT.capitalize().replace(" ", "\n"), "mit"),
    (MIT.replace("obtaining", "who gets"), "mit"),
    (MIT.replace("free of charge", "for a fee"), ""),
    ("permission is hereby granted free of charge and nothing else without restriction", ""),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "all-rights-reserved,bsd"),
    ("rights all reserved", ""),
    ("K under the mıt license", ""),
    (None, ""),
    ("", ""),
    ("word " * 30_000 + "apache license version 2 " * 300, "apache-2"),
]


def test_licences(spark):
    filler = [(100 + i, "the of to and in this is use copy is with or " * 3, "") for i in range(60)]
    rows = [(i % 5 or None, t, "old") for i, (t, _) in enumerate(TEXTS)] + filler
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, doc_id long, text string, labels string")
    scanned = license_scan.scan(docs)
    assert "Python" not in scanned._jdf.queryExecution().executedPlan().toString()
    got = sorted(scanned.collect(), key=lambda r: r.k)
    for r, (_, text, _) in zip(got, rows, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(text)
    assert [r.labels for r in got[: len(TEXTS)]] == [want for _, want in TEXTS]
    assert all((r.score > 0) == bool(r.labels) and 0 <= r.score <= 1 and (r.score == 1 or not r.base_labels) for r in got)
    assert not any(r.labels for r in got[len(TEXTS) :])


def test_licences_of_tiny_and_empty_tables(spark, nothing):
    one = spark.createDataFrame([("all rights reserved",)], "text string")
    assert license_scan.scan(one).first().labels == "all-rights-reserved"
    assert license_scan.scan(nothing).collect() == []


# Audit


def brute_audit(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        terms = Counter(x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        counts[group].update(terms)
        docs[group[0]].update(terms.keys())
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= min_docs) for lang, _ in groups}
    utf8, out = lambda x: x.encode(), []

    def share(lang, count):
        total = sum(count[t] for t in kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    p = {g: share(g[0], counts[g]) for g in groups}
    for lang, source in groups:
        mine = p[lang, source]
        q = share(lang, sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = [(o, sum(abs(mine[t] - p[lang, o][t]) for t in kept[lang])) for x, o in groups if x == lang and o != source]
        terms = [(t, mine[t] - q[t]) for t in kept[lang] if counts[lang, source][t] and mine[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[1], utf8(x[0])))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked[: None if part == "pair" else top], 1)]
    return sorted(out)


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    names = ["the", "The", "été", "ｆ", "𝒜b", "z", "a1b", "x_y", "É"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = [(" ".join(rng.choices(names, k=rng.randint(0, 40))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "B", "é", None])) for _ in range(300)]
    rows += [(None, "xx", "a"), ("once", "xx", "b"), ("", "yy", "only"), ("tie tie", "en", "a")] + [("w " * 500 + "L" * 5000, "en", "long")] * 3
    monkeypatch.setattr(source_audit, "CHUNK", 16)  # several chunks a language
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, item int").repartition(3)
    got = source_audit.audit(docs, min_docs=5, top=7).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, 5, 7)


def test_audit_counts_exactly():
    import numpy as np

    big = np.array([10**12, 3, 0, 9 * 10**14])
    assert source_audit.frequencies(big, 9 * 10**14 + 7, 12_345).tolist() == [1 + 10**9 * (int(c) + 5) // (9 * 10**14 + 7 + 5 * 12_345) for c in big]


def test_audit_merges_what_tasks_counted(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "ROWS", 10)
    monkeypatch.setattr(source_audit, "STEP", 64)
    rows = [(f"a b c d{chr(97 + i % 7)}", "en", f"s{i % 2}") for i in range(80)]
    got = source_audit.audit(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=10, top=5).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, 10, 5)


def test_audit_sql_on_ties(spark, tmp_path):
    rows = [(f"{x} same same", "en", s) for x in ("b", "a", "Z") for s in ("s", "t", "u") for _ in range(31)]
    spark.createDataFrame(rows, "text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(source_audit.SQL)
    columns, want = found.columns, sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in source_audit.audit_query(spark, str(tmp_path)).collect()) == want
