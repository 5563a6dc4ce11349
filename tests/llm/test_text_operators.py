"""Operators against brute force on small tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard_join, katz, language_id, pii, quality_classifier, quality_rules, sentencepieces, sharding, url_filter
from millrace.llm.graph import components
from millrace.llm.words import hashes, utf8, words
from millrace.session import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1f漢", max_size=30)), max_size=6))
def test_words(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    starts, ends, at = words(data, offsets)
    raw = data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]])] for k in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    flat = [w.translate(LOWER) for t in got for w in t]
    h = hashes(data, starts, ends).tolist()
    assert all((a == b) == (x == y) for a, x in zip(flat, h) for b, y in zip(flat, h))


# --- sharding


def test_sharding(spark, docs, corpus, tmp_path):
    done = sharding.write_shards(docs, str(tmp_path / "a"), bucket_bytes=4096)
    rows = done.collect()
    assert sorted(r.doc_id for r in rows) == [r[0] for r in corpus] and {r.doc_id: r.text for r in rows} == {r[0]: r[1] for r in corpus}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    place = {r.doc_id: (r.shard, r.slot) for r in rows}
    again = sharding.write_shards(docs.repartition(5), str(tmp_path / "b"), bucket_bytes=4096)
    assert {r.doc_id: (r.shard, r.slot) for r in again.collect()} == place
    other = sharding.write_shards(docs, str(tmp_path / "c"), seed=5, bucket_bytes=4096)
    assert {r.doc_id: (r.shard, r.slot) for r in other.collect()} != place


def test_sharding_repeats_and_nothing(spark, nothing, tmp_path):
    same = spark.createDataFrame([(1, "x", 9)] * 20, "doc_id long, text string, slot int")
    rows = sharding.write_shards(same, str(tmp_path / "a"), shards=4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(5)]
    assert sharding.write_shards(nothing, str(tmp_path / "b")).count() == 0


def test_sharding_of_many_repeats(spark, tmp_path, monkeypatch):
    """Equal rows are spread over the buckets; clashing names and rows that differ in another column only are kept apart."""
    monkeypatch.setattr(sharding, "REPEATS", 10)
    monkeypatch.setattr(sharding, "RUN", 3)
    data = [(1, "copy " * 20, 7, "k")] * 200 + [(2, "copy " * 20, k, None) for k in range(30)] + [(k, "x" * (k % 90), k, "") for k in range(3, 100)] + [(None, None, None, None)] * 3
    frame = spark.createDataFrame(data, "doc_id long, text string, first_row long, bucket string")
    done = sharding.write_shards(frame, str(tmp_path / "a"), shards=4, bucket_bytes=2048)
    got = [tuple(r) for r in done.collect()]
    assert sorted(map(repr, (r[:4] for r in got))) == sorted(map(repr, data))
    by = [sorted(r[4] for r in got if r[5] == s) for s in range(4)]
    assert all(v == list(range(len(v))) for v in by) and max(map(len, by)) - min(map(len, by)) <= 1
    assert all(20 < sum(r[5] == s and r[0] == 1 for r in got) < 80 for s in range(4))
    again = sharding.write_shards(frame.repartition(7), str(tmp_path / "b"), shards=4, bucket_bytes=2048)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, done.collect()))


def test_first_rows(spark):
    counts = [(b, b % 5 + 1) for b in range(0, 10_000, 7)]
    got = {r.bucket: r.first_row for r in sharding._first_rows(spark.createDataFrame(counts, "bucket long, n long")).collect()}
    total, want = 0, {}
    for b, n in counts:
        want[b] = total
        total += n
    assert got == want


# --- quality rules


def base_counts(text):
    w = WORD.findall(text or "")
    seen, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality_counts(spark, docs, corpus):
    extra = [(900, "a b c d a b c\na b c d a b c\n\n x | y", None, None, 0, "", ""), (901, "q q q q q", None, None, 0, "", "")]
    got = quality_rules.measure(docs.unionByName(spark.createDataFrame(extra, docs.schema)).select("doc_id", "text")).collect()
    want = {r[0]: base_counts(r[1]) for r in corpus + extra}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want


def test_outliers(spark, rows):
    rng = random.Random(4)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(120)), "en", "big" if i % 3 else "other") for i in range(300)]
    junk = [(1000 + i, " ".join("x" * rng.randint(2, 5) + "###|" for _ in range(80)), "en", "big") for i in range(12)]
    small = [(2000 + i, clean[i][1], None, f"rare{i}") for i in range(5)]
    judged = quality_rules.quality_rules(spark.createDataFrame(clean + junk + small, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id for r in judged.filter("kept").collect()}
    assert kept == {r[0] for r in clean + small}
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_third_of_junk(spark):
    """A third of a group is copies of one junk page that passes the base rules; all of it goes and nothing else."""
    rng = random.Random(8)
    make = lambda n, end: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) + end for _ in range(n))
    clean, page = [(i, make(120, ""), "en", "hot") for i in range(200)], make(80, "###|")
    junk = [(1000 + i, page, "en", "hot") for i in range(100)]
    judged = quality_rules.quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in judged) and {r.doc_id for r in judged if r.kept} == {r[0] for r in clean}


def test_quality_stage(spark, docs, corpus, nothing):
    """The stage keeps the whole rows that the operator keeps, repeated ids and clashing column names included."""
    clash = docs.unionByName(docs.filter("doc_id < 5")).withColumn("n_words", F.lit(7)).withColumn("key", F.lit("k"))
    kept = {r.doc_id for r in quality_rules.quality_rules(clash).filter("kept").collect()}
    out = quality_rules.quality_stage(spark, clash, "")
    assert out.schema.fieldNames() == clash.schema.fieldNames()
    want = [r for r in clash.collect() if r.doc_id in kept]
    assert 5 <= len(kept) < len(corpus) and sorted(map(repr, out.collect())) == sorted(map(repr, want))
    assert quality_rules.quality_stage(spark, nothing, "").count() == 0


def test_mahalanobis_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0.2, 0], [0, 0, 1, 0.4], [0, 0, 0, 1]])
    names, floors = list(quality_rules.STATISTICS), list(quality_rules.STATISTICS.values())
    frame = spark.createDataFrame([(0, "k", 0, len(x), *map(float, r)) for r in x], "level int, key string, start int, n long, " + ", ".join(f"{c} double" for c in names))
    moments = frame.groupBy("level", "key", "start").agg(F.first("n").alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c_{i}{j}") for i in range(4) for j in range(i + 1)])
    factor = quality_rules._factor(moments, floors, 1.3)
    got = np.sort([r[0] for r in frame.join(factor.drop("n", "start"), ["level", "key"]).select(quality_rules._distance(names)).collect()])
    cov = np.cov(x.T, bias=True) * 1.3 + np.diag(np.square(floors))
    want = np.sort(np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0)))
    assert np.allclose(got, want)


def numpy_mcd(x, floors, starts, rng):
    """The least log determinant of a regularised half found by concentration steps from random starts, and its members."""
    n, p = x.shape
    share = quality_rules.SHARE
    scale, best = share / quality_rules._cdf(quality_rules._quantile(share, p), p + 2), (np.inf, None)
    for _ in range(starts):
        some = rng.choice(n, p + 1, replace=False)
        for _ in range(60):
            m, c = x[some].mean(axis=0), np.cov(x[some].T, bias=True) * scale + np.diag(np.square(floors))
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d, kind="stable")[: n // 2]
            if set(new) == set(some):
                break
            some = new
        best = min(best, (np.linalg.slogdet(c)[1], tuple(sorted(some))))
    return best


@pytest.mark.parametrize("seed,share", [(1, 0.0), (2, 0.3), (3, 0.4)])
def test_mcd_matches_numpy(spark, monkeypatch, tmp_path, seed, share):
    """No half that random starts find has a smaller determinant; hot and dealt groups agree."""
    rng = np.random.default_rng(seed)
    floors = list(quality_rules.STATISTICS.values())
    n, bad = 120, int(120 * share)
    x = rng.normal(size=(n, 4)) @ np.array([[0.3, 0.8, 0, 0], [0, 1, 0.5, 0], [0, 0, 0.6, 0.4], [0, 0, 0, 0.5]])
    x[:bad] = x[:bad] * 0.5 + np.array([40, 30, -20, 20])
    data = [(False, "en", "s", *map(float, r)) for r in x] + [(False, "en", f"t{k % 3}", *map(float, r)) for k, r in enumerate(rng.normal(size=(180, 4)))]
    frame = spark.createDataFrame(data, "base_failed boolean, lang string, source string, " + ", ".join(f"{c} double" for c in quality_rules.STATISTICS))
    steps = {}

    class Kept(Scratch):
        def table(self, name, frame):
            steps[name] = super().table(name, frame)
            return steps[name]

    quality_rules.fit(frame, Kept(spark, "mcd"))
    key = '["en","s"]'
    got = steps["least"].filter((F.col("level") == 0) & (F.col("key") == key)).first()
    want = numpy_mcd(x, floors, 200, rng)
    assert 2 * sum(math.log(got[f"l_{i}{i}"]) for i in range(4)) <= want[0] + 0.02
    assert steps["start"].filter((F.col("level") == 0) & (F.col("key") == key)).count() == 3
    first = steps["reweighted"].orderBy("level", "key").collect()
    monkeypatch.setattr(quality_rules, "HOT", 2)
    quality_rules.fit(frame, Kept(spark, "mcd"))
    again = steps["reweighted"].orderBy("level", "key").collect()
    assert len(first) == len(again) == 6 and all(np.allclose(a[3:], b[3:], rtol=1e-2, atol=1e-2) for a, b in zip(first, again))


# --- personal data


def regex_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="019.@a-+ ()_é4", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == regex_base(text)


def test_added_spans():
    model = pii.trained()
    for text, kind, span in [
        ("please call (017) 555-7713 today", "phone", "(017) 555-7713"),
        ("write to jan.22 (at) mail (dot) org now", "email", "jan.22 (at) mail (dot) org"),
        ("the server 10[.]0[.]12[.]7 is down", "ip", "10[.]0[.]12[.]7"),
    ]:
        base, spans = pii.all_spans(text, model)
        assert base == [] and [(k, text[s:e]) for k, s, e in spans] == [(kind, span)]
    for text in ("order 2024-11-05 of item 9807915762804490 here", "isbn 978-3-1614-8410-0 version 1.2.3", "meet at home.\nIt is 1234567 now"):
        assert pii.all_spans(text, model)[1] == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("phone 555-123-4567 555-987-6543", ["phone 555-123-4567", "phone 555-987-6543"]),
        ("call (555) 123-4567 (555) 987-6543 now", ["phone (555) 123-4567", "phone (555) 987-6543"]),
        ("card 4111.1111.1111.1111 12/27", ["card 4111.1111.1111.1111"]),
        ("host 10[.]1[.]2[.]3 8080", ["ip 10[.]1[.]2[.]3"]),
        ("Tel 12 555-123-4567", ["phone 555-123-4567"]),
        ("tel (555) 123-4567 10.1.2.3", ["phone (555) 123-4567", "ip 10.1.2.3"]),
    ],
)
def test_neighbouring_numbers(text, want):
    assert [f"{k} {text[s:e]}" for k, s, e in pii.all_spans(text, pii.trained())[1]] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0159 .()-+[]\ta", max_size=40))
def test_candidates_are_all_stretches(text):
    """Every stretch of whole digit groups with small gaps is proposed where its digits fit the kind."""
    groups, want = [m.span() for m in re.finditer("[0-9]+", text)], set()
    for i, (first, _) in enumerate(groups):
        for j in range(i, len(groups)):
            inside = text[first : groups[j][1]]
            if re.fullmatch(r"[0-9]+(?:[ .\t()/\[\]-]{1,3}[0-9]+)*", inside):
                n, start = sum(c in "0159" for c in inside), first - (text[max(0, first - 1) : first] in ("(", "+"))
                want |= {(kind, start, groups[j][1]) for kind, fits in (("card", 12 <= n <= 19), ("phone", 7 <= n <= 15), ("ip", j - i == 3 and n <= 12)) if fits}
    got = pii.candidates(text)
    assert set(got) == want and len(got) == len(want)


def test_pii_trees_hold_out():
    model, held = pii.trained(), list(pii.examples(1500, 77))
    p, y = model.probability(np.array([pii.features(*e[:4]) for e in held], float)), np.array([e[4] for e in held])
    chosen = p >= np.array([model.threshold[e[1]] for e in held])
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.9


def test_pii_contexts(spark, docs, corpus, nothing):
    """Contexts are pieces of the texts, from repeated texts once, the same on each run."""
    pieces = pii.contexts_of(docs)
    texts = {r[1] for r in corpus if r[1] is not None}
    assert len(pieces) == pii.SNIPPETS * len(texts) and all(any(p in t for t in texts) and len(p) <= pii.SNIPPET for p in pieces)
    assert pii.contexts_of(docs.repartition(5)) == pieces and pii.contexts_of(nothing) == ()
    assert len(pii.contexts_of(docs, max_texts=5)) <= 45


def test_pii_planted_in_documents(spark, docs):
    """Loose formats planted in pieces of texts that the trees haven't seen: precision and recall of the added spans."""
    model, rng = pii.train(docs), random.Random(5)
    pieces = [" ".join("".join(rng.choice("aeioubdkmnprst") for _ in range(rng.randint(2, 9))) for _ in range(30)) for _ in range(100)]
    true = collections.defaultdict(set)
    for text, *span, label in pii.examples(600, 991, pieces):
        true[text] |= {tuple(span)} if label else set()
    found = {text: set(pii.all_spans(text, model)[1]) - set(pii.base_spans(text)) for text in true}
    hits, given, wanted = sum(len(found[t] & true[t]) for t in true), sum(map(len, found.values())), sum(map(len, true.values()))
    assert hits > 250 and hits / given > 0.95 and hits / wanted > 0.95
    assert all(0 < model.threshold[k] <= 1 for k in pii.KINDS)


def test_pii_stage(spark, nothing, docs):
    text = "é mail a.b@c.de, ip 10.0.0.1 and +1 (017) 555-7713."
    rows = spark.createDataFrame([(1, text, 5), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.pii_stage(spark, rows, "").collect()}
    assert got[1].text == "é mail [EMAIL], ip [IP] and [PHONE]." and got[1].n_chars == len(got[1].text) and got[2].text is None and got[3].text == ""
    assert pii.redact("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"
    assert pii.find_pii(nothing).count() == 0 and pii.pii_stage(spark, docs, "").columns == docs.columns


# --- language


def test_language(spark, docs, nothing):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(60))
    data = [(i, make(a), lang) for i, (a, lang) in enumerate([("abcde", "aa"), ("fghij", "bb"), ("éèàçù", "cc")] * 60)]
    train = spark.createDataFrame([r for r in data if r[0] % 4], "doc_id long, text string, lang string")
    test = [r for r in data if r[0] % 4 == 0] + [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None)]
    model = language_id.train(train)
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(test, train.schema), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in test[:-3]) and {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    far = language_id.predict(spark.createDataFrame([(1, "ΩΨΣ " * 30)], "doc_id long, text string"), model).first()
    assert far.rejected and far.lang_pred in ("aa", "bb", "cc")
    assert language_id.train(nothing) is None and language_id.predict(docs, None).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.predict(nothing, model).count() == 0


def plain_language(train, test, centroids):
    """Nearest centroid by dictionaries of trigrams, for languages with at most ``centroids`` texts: each text is a centroid."""

    def grams(t):
        fold = [32 if not (c >= 128 or chr(c).isalpha()) else c for c in t.lower().encode()]
        slots = [((((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 20) for a, b, c in zip(fold, fold[1:], fold[2:]) if not (a == 32 and b == 32)]
        return {k: math.log1p(v) for k, v in collections.Counter(slots).items()}

    every = [(grams(t), lang) for t, lang in train]
    df = collections.Counter(k for g, _ in every for k in g)

    def unit(g):
        v = {k: x * (math.log((1 + len(every)) / (1 + df[k])) + 1) for k, x in g.items()}
        n = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {k: x / n for k, x in v.items()}

    centres = [(unit(g), lang) for g, lang in every]
    out = []
    for t in test:
        u = unit(grams(t))
        best = {}
        for c, lang in centres:
            best[lang] = max(best.get(lang, -1.0), sum(x * c.get(k, 0.0) for k, x in u.items()))
        lang = max(sorted(best), key=best.get)
        out.append((lang, 1 / sum(math.exp(40 * (v - best[lang])) for v in best.values())))
    return out


def test_language_matches_plain(spark):
    """With as many centroids as texts the operator is plain nearest neighbour; ids are texts, one language has one text."""
    rng = random.Random(5)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(40))
    train = [(make(a), lang) for a, lang in [("abcdefg", "aa"), ("efghijk", "bb"), ("éèàdefg", "cc")] * 3] + [(make("xyzé"), "dd")]
    test = [make(a) for a in ("abcdefg", "efghijk", "éèàdefg", "xyzé", "aeiou") * 3]
    model = language_id.train(spark.createDataFrame([(f"t{k}", *r) for k, r in enumerate(train)] * 2, "doc_id string, text string, lang string"))
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([(f"q{k:02}", t) for k, t in enumerate(test)], "doc_id string, text string"), model).collect()}
    want = plain_language(train * 2, test, 3)
    for k, (lang, score) in enumerate(want):
        assert got[f"q{k:02}"].lang_pred == lang and math.isclose(got[f"q{k:02}"].score, score, abs_tol=2e-2)


def test_language_sample(spark):
    """More languages than the sample asks for are all learnt; a text repeated many times is one of the sample."""
    rows = [(1, "aaa bbb " * 9, "xx")] * 3000 + [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * 20, f"l{k}") for k in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_sample=5)
    assert len(model.languages) == 41 and len(model.centroids) == 41


# --- quality classifier


def test_classifier(spark, nothing, docs):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200)))
    bad = lambda: " ".join("".join(rng.choice("ABCDE") for _ in range(rng.randint(2, 8))) + "!!" for _ in range(rng.randint(60, 200)))
    data = [(i, good() if i % 2 else bad()) for i in range(160)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(101, None)], "doc_id long, quality int")
    model = quality_classifier.train(frame, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(frame, model).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(100, 160))
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(docs, model).collect()) and quality_classifier.score(nothing, model).count() == 0
    assert quality_classifier.train(frame, labels.limit(0)) == 0.5 and quality_classifier.train(frame, labels.filter("quality = 1")) == 1.0


def plain_passages(text):
    """The features of a text's passages, one at a time."""
    raw = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    groups = [spans[k : k + 64] for k in range(0, len(spans), 64)] or [[]]
    begins = [0, *(g[0][0] for g in groups[1:]), len(raw)]
    out = []
    for g, low, high in zip(groups, begins, begins[1:]):
        part, w = raw[low:high], [raw[a:b].lower() for a, b in g]
        kinds = [sum(quality_classifier._CLASS[c] == k for c in part) / max(len(part), 1) for k in range(quality_classifier.CLASSES)]
        n = max(len(w), 1)
        stats = [math.log1p(len(w)), sum(map(len, w)) / n, len(set(w)) / n, len(set(zip(w, w[1:], w[2:]))) / n]
        low_part, pairs = part.lower(), [0] * quality_classifier.PAIRS
        for a, b in zip(low_part, low_part[1:]):
            pairs[((a * 0x9E37 + b * 0x85EB) >> 3) % quality_classifier.PAIRS] += 1
        out.append(kinds + stats + [math.sqrt(p / max(len(part), 1)) for p in pairs])
    return np.array(out)


def test_passages(corpus):
    """Against the plain version; and each text alone has the same passages as in a batch, in any order."""
    texts = [r[1] or "" for r in corpus] + ["one two three four five six seven eight nine ten"] * 2 + ["x y " * 100]
    want = [plain_passages(t) for t in texts]
    for order in (range(len(texts)), reversed(range(len(texts)))):
        order = list(order)
        x, at = quality_classifier.passages(*utf8(pa.array([texts[k] for k in order])))
        assert all(np.allclose(x[at[i] : at[i + 1]], want[k], atol=1e-5) for i, k in enumerate(order))
    for k, t in enumerate(texts):
        assert np.allclose(quality_classifier.passages(*utf8(pa.array([t])))[0], want[k], atol=1e-5)


def test_classifier_sample(spark, monkeypatch):
    """Repeated rows of one id teach once, and the sample keeps to its bounds; ids may be texts."""
    taught = []
    monkeypatch.setattr(quality_classifier, "fit", lambda bags, y: taught.append((len(bags), sum(map(len, bags)), y.tolist())) or 0.25)
    rows = [("a", "w " * 64, 0)] * 500 + [(f"i{k}", "w " * 640, k) for k in range(20)] + [(None, "w", 0)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, id int")
    labels = spark.createDataFrame([("a", 0), ("a", None), (None, 1), *((f"i{k}", 1) for k in range(20))], "doc_id string, quality int")
    assert quality_classifier.train(frame, labels) == 0.25 and taught.pop()[:2] == (21, 201)
    monkeypatch.setattr(quality_classifier, "MAX_PASSAGES", 95)
    assert quality_classifier.train(frame, labels) == 0.25 and taught.pop()[:2] == (10, 91)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    w = {"encode": rng.normal(size=(5, 4)), "encode_bias": rng.normal(size=4), "value": rng.normal(size=(4, 3)), "gate": rng.normal(size=(4, 3)), "attend": rng.normal(size=3), "out": rng.normal(size=4), "out_bias": rng.normal(size=1)}
    x, at, y = rng.normal(size=(7, 5)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := quality_classifier._forward(w, x, at)["p"]) + (1 - y) * np.log(1 - p))
    grad = quality_classifier._gradient(w, x, at, y)
    for name, v in w.items():
        for k in list(np.ndindex(v.shape))[:6]:
            v[k] += 1e-6
            up = loss()
            v[k] -= 2e-6
            assert math.isclose((up - loss()) / 2e-6, grad[name][k], rel_tol=1e-4, abs_tol=1e-7)
            v[k] += 1e-6


# --- urls


def test_url_rules(spark, folder):
    urls = ["http://a.b.com/en/5?x=1", "https://EXAMPLE.com/en/77", "http://x.example.net/de/8", "http://example.net/de/9#f", "http://notcom/en/1", "http://com/en/", "http://q.org/es/1", "http://q.org/esx", None, "mailto:a", "x://y", "a://b://c/d", "http://h?p://q"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(frame).collect()}
    assert got == {
        0: ("a.b.com", "/en/5", "com/en/"), 1: ("example.com", "/en/77", "example.com/en/7"), 2: ("x.example.net", "/de/8", "example.net/de/8"), 3: ("example.net", "/de/9", "net/de/"), 4: ("notcom", "/en/1", None),
        5: ("com", "/en/", "com/en/"), 6: ("q.org", "/es/1", "org/es/"), 7: ("q.org", "/esx", None), 8: ("", "", None), 9: ("", "", None), 10: ("y", "", None), 11: ("b:", "//c/d", None), 12: ("h", "", None),
    }
    assert url_filter.filter_urls(frame.limit(0)).count() == 0


def plain_features(url, host, path):
    """The lexical features of a url, one by one."""
    url = url or ""
    n = max(len(url), 1)
    query = re.match(r"(?s)[^?#]*\?([^#]*)", url)
    query = query[1] if query else ""
    share = [url.count(c) / n for c in set(url)]
    return [len(url) or 1, path.count("/"), sum(c in "0123456789" for c in url) / n, -sum(p * math.log2(p) for p in share), query.count("&") + 1 if query else 0, query.count("="), host.count(".") + 1, host.count("-"), len(host)]


def test_url_features(spark):
    """Features against a plain version, and suffix statistics over all labelled urls, however few are sampled."""
    urls = ["http://a-b.example.com/en/5?x=1&y=2#z=3", "https://EXÄMPLE.com/en/77/", "x://y", "http://h?p://q", "no scheme 12", "http://q.org/es/1?=", "a" * 500]
    rows = spark.createDataFrame([(u,) for u in urls], "page_url string")
    host, path = url_filter.split_url(F.col("page_url"))
    found = url_filter.lexical(rows.withColumns({"host": host, "path": path}), "page_url").collect()
    for r in found:
        assert np.allclose([r[c] for c in url_filter.FEATURES[:9]], plain_features(r.page_url, r.host, r.path))
    rng = random.Random(2)
    many = [(k, f"http://h{rng.randrange(99)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(9)}?n={k}") for k in range(600)] + [(k, "http://x.com/en/1") for k in range(300)]
    frame = spark.createDataFrame(many, "page_key long, page_url string").withColumns({"host": host, "path": path})
    rule, verdict = url_filter.rule_of(F.col("host"), F.col("path"))
    labelled = url_filter.lexical(frame.withColumns({"rule": rule, "rule_verdict": verdict}), "page_url")
    known = [(r.suffix, r.rule_verdict == "block") for r in labelled.filter("rule_verdict IS NOT NULL").collect()]
    model = url_filter.train(labelled, Scratch(spark, "urls"), max_sample=40)
    got = {r.suffix: (r.suffix_rate, r.suffix_share) for r in model.suffixes.collect()}
    overall = sum(b for _, b in known) / len(known)
    for suffix in {x for x, _ in known}:
        n, blocked = sum(x == suffix for x, _ in known), sum(b for x, b in known if x == suffix)
        assert np.allclose(got[suffix], [(blocked + 10 * overall) / (n + 10), n / len(known)])


def test_url_trees_hold_out(spark):
    rng = random.Random(8)
    bad = lambda: f"http://{''.join(rng.choice('abc0123456789-') for _ in range(25))}.com/en/{rng.randrange(9**9)}?a=1&b=2&c={rng.randrange(9**9)}"
    good = lambda: f"http://{''.join(rng.choice('aeioklm') for _ in range(7))}.net/de/{''.join(rng.choice('aeioklm') for _ in range(6))}"
    train = [(i, bad() if i % 2 else good()) for i in range(300)]
    test = [(1000 + i, (bad() if i % 2 else good()).replace("/en/", "/xx/").replace("/de/", "/xx/")) for i in range(60)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(train + test, "page_id long, url string")).collect()}
    assert all(got[i].rule is None and (got[i].verdict == "block") == bool(i % 2) for i, _ in test)
    entropy = url_filter.lexical(spark.createDataFrame([("aabb", "", "")], "u string, host string, path string"), "u").first()["f_entropy"]
    assert math.isclose(entropy, 1.0)


# --- pieces


@pytest.fixture(scope="module")
def pieces():
    pytest.importorskip("sentencepiece")
    import os

    if not os.path.exists(sentencepieces.MODEL):
        pytest.skip("no model file here")
    return sentencepieces.load()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abthe THE\n é漢Ω1ing😀.,-", max_size=40), max_size=5))
def test_pieces_match_the_library(pieces, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, at = sentencepieces.encode_block(data, offsets, pieces)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [sp.encode(t) for t in texts]
    back, back_at = sentencepieces.decode_block(ids, at, pieces)
    assert back.tobytes() == data.tobytes() and back_at.tolist() == offsets.tolist()


def test_long_runs(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    texts = [" " * k + x for k in (0, 1, 15, 16, 17, 31, 33, 100, 5000) for x in ("", "the", "\n")] + ["a" * 400, "the" * 100]
    ids, at = sentencepieces.encode_block(*utf8(pa.array(texts)), pieces)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [sp.encode(t) for t in texts]


def test_words_are_remembered(pieces, monkeypatch):
    """Blocks that share words with earlier ones, with a memory that is started anew now and then."""
    import sentencepiece

    monkeypatch.setattr(sentencepieces, "MEMO_WORDS", 60)
    sp, rng, memo = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL), random.Random(7), sentencepieces.Memo()
    for _ in range(12):
        texts = [" ".join("".join(rng.choice("theanding") for _ in range(rng.randint(1, 3))) for _ in range(40)) for _ in range(3)] + ["x" * 400, ""]
        ids, at = sentencepieces.encode_block(*utf8(pa.array(texts)), pieces, memo)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [sp.encode(t) for t in texts]


def test_unspaced_texts(pieces):
    """Long words: random letters, base64, words without spaces, runs whose pieces have every period, and a million characters."""
    import sentencepiece
    import time

    sp, rng = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL), random.Random(3)
    words_ = "the and ation international ing code function return value strength of".split()
    texts = ["".join(rng.choice(a) for _ in range(n)) for n in (250, 299, 300, 301, 302, 541, 900, 5000) for a in ("abcdefghijklmnop", "ABCdef0123+/", "etaoin")]
    texts += ["".join(rng.choice(words_) for _ in range(n)) for n in (60, 200, 900)]
    texts += [(p * 2000)[:n] for p in ("a", "ab", "the", "abcd", "hello", "------=", "0", "=-", "information") for n in (700, 1999)]
    ids, at = sentencepieces.encode_block(*utf8(pa.array(texts)), pieces)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == sp.encode(t), t[:40]
    long = "".join(rng.choice("ABCDefgh0123+/the") for _ in range(1_000_000))
    began = time.time()
    ids, _ = sentencepieces.encode_block(*utf8(pa.array([long])), pieces)
    assert time.time() - began < 60 and sum(pieces.length[ids]) == len(long) + 1
    assert ids.tolist()[:2000] == sp.encode(long[:20_000])[:2000]


def test_encode_and_decode(spark, docs, corpus, nothing, pieces):
    coded = sentencepieces.encode(docs)
    assert coded.filter("NOT round_trip").count() == 0 and sentencepieces.encode(nothing).count() == 0
    assert {r.doc_id: r.text for r in sentencepieces.decode(coded).collect()} == {r[0]: r[1] for r in corpus}


# --- benchmark


def test_distance():
    rng = random.Random(3)
    for _ in range(60):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 7))], [rng.randrange(4) for _ in range(rng.randint(0, 9))]

        def plain(x, y):
            d = list(range(len(y) + 1))
            for i, u in enumerate(x, 1):
                d, old = [i] + [0] * len(y), d
                for j, v in enumerate(y, 1):
                    d[j] = min(old[j] + 1, d[j - 1] + 1, old[j - 1] + (u != v))
            return d[-1]

        want = min(plain(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        got, low, high = decontamination.distance(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == want == plain(a, b[low:high])


def test_decontamination(spark, nothing):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioubdk") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 40)))) for i in range(40)] + [(90, "absent"), (91, None)]
    data, truth = [], set()
    for k in range(160):
        i, text = items[k % 40]
        w = text.split()
        for _ in range(rng.randint(0, decontamination.allowed(len(w)))):
            j, what = rng.randrange(len(w)), rng.randrange(3)
            w[j : j + 1] = [["zzz"], [], [w[j], "yyy"]][what]
        data.append((k, " ".join([*(word() for _ in range(30)), *w, *(word() for _ in range(30))]).upper() + "."))
        truth.add((k, i))
    data += [(1000 + k, " ".join(word() for _ in range(200))) for k in range(40)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame([(*d, 1) for d in data], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_items(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= truth and len(got) >= 0.95 * len(truth)
    texts = dict(data)
    whole = [r for r in found if r.edits == 0]
    assert whole and all(tokens(texts[r.doc_id][r.start : r.end]) == dict(items)[r.item_id].split() for r in whole)
    assert decontamination.find_items(nothing, bench).count() == 0 and decontamination.find_items(docs, bench.limit(0)).count() == 0


def test_anchor_width():
    """However the allowed edits fall, a run of that many words stays."""
    for m in range(1, 200):
        k = decontamination.allowed(m)
        runs = k + 1
        assert decontamination.anchor_width(m) == min(3, -(-(m - k) // runs)) >= 1


def test_short_and_long_items(spark, monkeypatch):
    """Items of one to seven words and a long one, edited as far as allowed: all are found, nothing else is.

    With two walks at most, sizes from five words on miss the wanted share and go the exact way.
    """
    monkeypatch.setattr(decontamination, "MOST_WALKS", 2)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioubdk") for _ in range(rng.randint(5, 9)))
    items = [(m, " ".join(word() for _ in range(m))) for m in (1, 2, 3, 4, 5, 6, 7, 700)] + [(50, ""), (51, "?! --")]
    data, truth = [], set()
    for m, text in items[:8]:
        for k in range(decontamination.allowed(m) + 1) if m < 100 else (0, 60, 140):
            for trial in range(6 if m < 100 else 1):
                w = text.split()
                for j in sorted(rng.sample(range(m), k), reverse=True):
                    w[j : j + 1] = [["zzz"], [], [w[j], "yyy"]][rng.randrange(3)]
                data.append((len(data), " ".join([*(word() for _ in range(20)), *w, *(word() for _ in range(20))])))
                truth.add((len(data) - 1, m))
        w = text.split()
        w[m // 2 : m // 2 + decontamination.allowed(m) + 1] = ["other"] * (decontamination.allowed(m) + 1)
        data.append((len(data), " ".join(w)))
    index = decontamination.Index.build([t for _, t in items])
    assert sorted(index.walks) == [1, 2, 3, 4]
    bench = spark.createDataFrame(items + [(70, items[3][1]), (70, items[3][1])], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontamination.find_items(spark.createDataFrame(data, "doc_id long, text string"), bench).collect()]
    assert {f for f in found if f[1] != 70} == truth and sorted(f for f in found if f[1] == 70) == sorted([(d, 70) for d, m in truth if m == 4] * 2)


# --- near copies


def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = tokens(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_jaccard(spark, monkeypatch, width, percent, seed):
    monkeypatch.setattr(jaccard_join, "PART", 4)
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz")
    passage = [word() for _ in range(25)]
    data = []
    for _ in range(14):
        base = [word() for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            data.append(" ".join(w))
    data += [" ".join(passage + [word() for _ in range(rng.randint(5, 60))]) for _ in range(25)] + [None, "", " ", data[0], data[0].upper(), "a b", "A b", "b a"]
    rows = list(enumerate(data))
    frame = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, size int, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(frame, width=width, percent=percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_jaccard_of_nothing(nothing):
    assert jaccard_join.jaccard_join(nothing).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(50, 60), (60, 55), (55, 50), (100, 100)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "x long, y long"), Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 55: 50, 60: 50, 100: 100}
    assert components(spark.createDataFrame([], "x long, y long"), Scratch(spark, "test")).count() == 0


# --- language model


def brute_katz(rows):
    """Scores by dictionaries, and a check that the probabilities after a history sum to 1."""
    tok = {i: [*tokens(t), None] for i, t, _ in rows}
    held = {i: h for i, _, h in rows}
    c, p, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for i in tok:
        h = "begin"
        for w in () if held[i] else tok[i]:
            c[w] += 1
            p[h, w] += 1
            hist[h] += 1
            h = w
    total, distinct = sum(c.values()), len(c)
    d1, d2 = (katz.discounts([sum(v == r for v in x.values()) for r in range(1, katz.CUTOFF + 2)]) for x in (c, p))
    low = lambda n, d: n * (d[n - 1] if n <= katz.CUTOFF else 1.0)
    unknown = sum(n - low(n, d1) for n in c.values()) / total if total else 1.0
    one = lambda w: low(c[w], d1) / total if c[w] else unknown
    after = collections.defaultdict(list)
    for (h, w), n in p.items():
        after[h].append((w, n))
    alpha = {h: (1 + sum(n - low(n, d2) for _, n in x)) / (hist[h] + 1) / (1 - sum(one(w) for w, _ in x)) for h, x in after.items()}
    for h in list(after)[:4]:
        seen = {w for w, _ in after[h]}
        mass = sum(low(n, d2) / (hist[h] + 1) for _, n in after[h]) + alpha[h] * (sum(one(w) for w in c if w not in seen) + unknown)
        assert math.isclose(mass, 1.0, rel_tol=1e-9)
    out = {}
    for i in tok:
        h, s = "begin", 0.0
        for w in tok[i]:
            n = p[h, w]
            s += math.log10(low(n, d2) / (hist[h] + 1) if n else alpha.get(h, 1.0) * one(w))
            h = w
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tok[i])
        out[i] = (len(tok[i]), sum(c[w] > 0 for w in tok[i]), total, base, s if total else 0.0)
    return out


def katz_rows():
    """Texts in which words tend to follow each other."""
    rng = random.Random(21)

    def text(n):
        out, k = [], 0
        for _ in range(n):
            k = (k + 1) % 60 if rng.random() < 0.6 else rng.randrange(60)
            out += ["w%d" % k] + (["the"] if rng.random() < 0.3 else [])
        return " ".join(out)

    data = [(i, text(rng.randint(0, 50))) for i in range(150)] + [(200, None), (201, ""), (202, "Only NEW words"), (203, "THE w1 the w2")]
    return [(i, t, zlib.crc32(str(i).encode()) % 7 == 2) for i, t in data]


@pytest.mark.parametrize("hot,coded,size", [(1024, 60_000, 600_000), (4, 20, 300)])
def test_katz(spark, monkeypatch, hot, coded, size):
    """With production bounds, and with bounds so small that all paths are taken."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "CODED", coded)
    monkeypatch.setattr(katz, "SLICE", size)
    rows = katz_rows()
    frame = spark.createDataFrame([(i, t, "u") for i, t, _ in rows], "doc_id long, text string, uid string").repartition(3)
    got = katz.score_texts(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
    want = brute_katz(rows)
    assert len(got) == len(rows)
    for r in got:
        n, k, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, k, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-7, abs_tol=1e-7)
    fair = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in fair) > sum(r.base_score for r in fair)


@pytest.mark.parametrize("hot,coded", [(1024, 60_000), (4, 20)])
def test_katz_tables(spark, monkeypatch, hot, coded):
    """The stored tables score texts: those of the corpus as the one pass does, and others as dictionaries do."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "CODED", coded)
    rows = katz_rows()
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored, model = katz.train_and_score(frame, held)
    want = {r.doc_id: r.score for r in scored.collect()}
    got = {r.doc_id: r.score for r in model.score(frame).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in got)
    pairs = collections.Counter()
    for i, t, h in rows:
        if not h:
            pairs.update(zip(["begin", *tokens(t)], [*tokens(t), None]))
    assert sorted(r.c for r in model.pairs.collect()) == sorted(pairs.values()) and model.pairs.select("pair").distinct().count() == len(pairs)
    other = [(900, "w1 w2 THE w3 unseen w4", True), (901, "", True), (902, None, True)]
    want = brute_katz(rows + other)
    got = {r.doc_id: r.score for r in model.score(spark.createDataFrame([o[:2] for o in other], "doc_id long, text string")).collect()}
    assert all(math.isclose(got[i], want[i][4], rel_tol=1e-9, abs_tol=1e-9) for i in got) and len(got) == 3


def test_katz_of_nothing(spark, nothing):
    assert katz.score_texts(nothing, F.lit(False)).count() == 0
    one = katz.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.score) == (3, 0, 0, 0.0)


def test_shards_split_repeats_by_bytes(spark, tmp_path):
    """Few copies of a long text are dealt to all buckets, too."""
    long = "x" * 20_000
    docs = spark.createDataFrame([(1, long)] * 300 + [(k, f"t{k}") for k in range(500)], "doc_id long, text string").repartition(4)
    rows = sharding.write_shards(docs, f"{tmp_path}/out", bucket_bytes=200_000).collect()
    held = {s: sum(r.doc_id == 1 and r.text == long for r in rows if r.shard == s) for s in range(16)}
    assert sum(held.values()) == 300 and min(held.values()) >= 5 and max(held.values()) <= 45
    assert all(len([r for r in rows if r.shard == s]) == 50 for s in range(16))


def test_pii_of_sentences_that_people_write():
    """Sentences that the generator of the training examples didn't make."""
    model = pii.trained()
    kinds = lambda t: [k for k, *_ in pii.all_spans(t, model)[1]]
    for t in ("write to us at help.desk.example.com", "Contact: meet at noon.today please", "phone call at 12.30.2024 10.15", "the server has 10 20 30 40 cores", "call 10 20 30 40 times", "dial 12 345 6789 people", "look at the point dot matrix"):
        assert kinds(t) == []
    for t, kind in (("call me on (555) 123-4567", "phone"), ("my number is 555.123.4567", "phone"), ("jane.doe (at) example dot com", "email"), ("write to jane.doe [at] example.com", "email"), ("host 10[.]0[.]0[.]7 is down", "ip"), ("visa 4111.1111.1111.1111 paid", "card")):
        assert kinds(t) == [kind]


@pytest.mark.parametrize("row", [12, 10**6])
def test_pii_of_tables_of_numbers(row):
    """A megabyte of numbers: rows of many digit groups propose nothing, and the base spans stay."""
    digits = [str(10 + i % 90) for i in range(330_000)]
    text = "\n".join(" ".join(digits[k : k + row]) for k in range(0, len(digits), row)) + " a@b.example.com"
    assert len(pii.candidates(text, True)) < 100
    assert [k for k, *_ in pii.all_spans(text, pii.trained())[1]] == ["email"] or pii.base_spans(text) == pii.all_spans(text, pii.trained())[0]


def test_pii_of_long_rows():
    """Rows of more than eight digit groups, numbers of more than six and long addresses are judged like all others."""
    model, four = pii.trained(), ["555-123-4567", "555-987-6543", "555-222-3344", "555-321-9876"]
    phones = lambda t: [t[s:e] for k, s, e in pii.all_spans(t, model)[1] if k == "phone"]
    assert phones("phone " + " ".join(four)) == four
    table = "\n".join(" ".join(str(10 + (7 * i + k) % 90) for k in range(12)) for i in range(60))
    assert phones(f"{table}\nphone " + " ".join(four)) == four
    assert ("phone", 5, 18) in pii.proposed("call 5 5 5 1 2 3 4") and ("card", 5, 28) in pii.proposed("card 41 11 11 11 11 11 11 11")
    name, host = "n" * 100, " dot ".join(["host"] * 9)
    assert pii.proposed(f"mail {name} (at) {host} now") == [("email", 5, 5 + len(f"{name} (at) {host}"))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="0123456789 .()-+[]\t/,\nmynubertlé²€$", max_size=200), st.integers(1, 9))
def test_pii_stretches_in_windows(text, size):
    """Stretches from windows of digit groups are those of the plain list, with the same features and probabilities."""
    model = pii.trained()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "SLICE", size)
        found = [(k, int(a), int(b), [float(x[r]) for x in f]) for k, s, e, f in pii.stretches(text) for r, (a, b) in enumerate(zip(s, e, strict=True))]
        want = [(*c, pii.features(text, *c)) for c in pii.proposed(text) if c[0] != "email"]
        assert sorted(found) == sorted(want)
        plain = pii.all_spans(text, model)
        patch.setattr(pii, "FEW", -1)
        assert pii.all_spans(text, model) == plain


def test_pii_stage_redacts_long_rows(spark):
    """The pipeline's step redacts numbers in a row of more than eight digit groups, too."""
    rows = spark.createDataFrame([(1, "phone 555-123-4567 555-987-6543 555-222-3344 555-321-9876", 0)], "doc_id long, text string, n_chars long")
    assert pii.pii_stage(spark, rows, "").first().text == "phone [PHONE] [PHONE] [PHONE] [PHONE]"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["1", "59", "105", "0010", "000000255", "5551234"]), st.sampled_from([" ", "-", "    ", " . ", "  [.]  ", ") (", " (", "+", " a ", "\t\t\t\t", " " * 70])), min_size=3, max_size=9))
def test_proposed_are_all_stretches(parts):
    """Every stretch of digit groups is proposed however wide its gaps are, and quads with any zeros; from arrays, too."""
    text = "".join(number + gap for number, gap in parts)
    groups, want = [m.span() for m in re.finditer("[0-9]+", text)], set()
    for i, (first, _) in enumerate(groups):
        for j in range(i, len(groups)):
            inside, parts = text[first : groups[j][1]], [text[s:e] for s, e in groups[i : j + 1]]
            if re.fullmatch(r"[0-9]+(?:[ .\t()/\[\]-]+[0-9]+)*", inside):
                n, start = sum(map(len, parts)), first - (text[max(0, first - 1) : first] in ("(", "+"))
                quad = j - i == 3 and all("." in g for g in re.findall("[^0-9]+", inside)) and (n <= 12 or all(int(x) <= 255 for x in parts))
                want |= {(kind, start, groups[j][1]) for kind, fits in (("card", 12 <= n <= 19), ("phone", 7 <= n <= 15), ("ip", quad)) if fits}
    got, arrays = pii.proposed(text), [(k, int(a), int(b)) for k, s, e, _ in pii.stretches(text) for a, b in zip(s, e, strict=True)]
    assert set(got) == want == set(arrays) and len(got) == len(want) == len(arrays)


@pytest.mark.parametrize("sign", ["(at)", " ( at ) ", "  [at]  ", " [   at   ] "])
@pytest.mark.parametrize("dot", [".", " dot ", " ( dot ) ", "   [dot]   "])
def test_addresses_with_wide_signs(sign, dot):
    name = f"jane.doe{sign}example{dot}co{dot}uk"
    assert pii.proposed(f"mail {name} now") == [("email", 5, 5 + len(name))]
    assert ("email", 8, 8 + len(name)) in pii.proposed(f"look at {name} now")


def test_pii_stage_redacts_wide_gaps(spark):
    """The pipeline's step redacts numbers and addresses whose parts stand far apart, too."""
    texts = {
        "call (555)    123-4567 now": "call [PHONE] now",
        "card 4111    1111    1111    1111": "card [CARD]",
        "host 10 [.] 0 [.] 0 [.] 7": "host [IP]",
        "server 0000000010[.]0000[.]0[.]7 is down": "server [IP] is down",
        "write to jane.doe ( at ) example ( dot ) com now": "write to [EMAIL] now",
        "mail jane.doe  [at]  example.com now": "mail [EMAIL] now",
        "chapter one ........ 12\nchapter two ........ 345 ........ 6789": "chapter one ........ 12\nchapter two ........ 345 ........ 6789",
        "mean   1250    3310      87\ntotal   2210    4415     192": "mean   1250    3310      87\ntotal   2210    4415     192",
    }
    rng = random.Random(8)
    others = [" ".join("".join(rng.choice("aeioubdkmnprst") for _ in range(rng.randint(2, 9))) for _ in range(40)) for _ in range(1000)]
    rows = spark.createDataFrame([(k, t, 0) for k, t in enumerate([*texts, *others])], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.text for r in pii.pii_stage(spark, rows, "").collect()} == dict(enumerate([*texts.values(), *others]))


@pytest.mark.parametrize("gap", [" " * 10**6, " . " * 10**5, "[" + " " * 70 + "]"])
def test_pii_of_very_wide_gaps(gap):
    """Gaps of a million characters don't break, or slow, the judging; as arrays and one by one it comes to the same."""
    text, model = gap.join(["call 555", "123", "4567", "10", "20"]), pii.trained()
    spans = [c for c in pii.proposed(text) if c[0] != "email"]
    assert sorted(spans) == sorted((k, int(a), int(b)) for k, s, e, _ in pii.stretches(text) for a, b in zip(s, e, strict=True)) and len(spans) > 5
    assert pii.all_spans(text, model)[0] == []
