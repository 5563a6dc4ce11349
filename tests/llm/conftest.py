import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, prefix string, n string"


def prose(rng, n, alphabet="aeioubdkmnprst"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and blank texts, copies, near copies and one long text, and columns with clashing names."""
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(40, 120)) for _ in range(60)]
    texts += [texts[0]] * 12 + [texts[1].replace(" ", "\n", 3)] * 2
    for k in range(10):
        w = texts[2].split()
        w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [None, "", " \t\n ", "one", "two words", "Ünï ÇODE é", prose(rng, 3000), "a b c " * 60]
    return [(i, t, None if i % 17 == 3 else ("en" if i % 2 else "fr"), None if i % 19 == 4 else f"s{i % 2}", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, corpus, tmp_path_factory):
    """A table folder with that corpus and the tables that queries read beside it."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(0, 80, 2)] + [(200, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = " ".join(corpus[5][1].split()[10:30])
    spark.createDataFrame([(1, item), (2, None), (3, "short item"), (4, prose(random.Random(9), 20))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    urls = [f"http{'s' if i % 2 else ''}://{h}.example.{t}/{p}/{i}?a={i}" for i in range(12) for h in ("www", "X-1") for t in ("com", "net", "org") for p in ("en", "de", "es")] + [None, "", "no scheme", "://", "http://COM/en/7#x"]
    spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path
