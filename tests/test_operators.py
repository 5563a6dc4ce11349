"""Operators on hand-made frames."""

import io
import random
import shutil
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import c_source, coverage, dashboard, dml, graph, joins, listing, streams, trees, windows
from millrace.sources import files, sinks


def test_pages(spark, rows):
    p = spark.createDataFrame([(i, f"{'B' if i % 2 else 'a'}{i % 3}", i // 2) for i in range(13)], "id int, name string, t int")
    assert rows(listing.envelope(p, 2, 12)) == [(13, 2, 12, 2)]
    assert rows(listing.envelope(p, 9, 12)) == [(13, 9, 12, 2)]
    assert [r.id for r in listing.page(listing.ordered(p, None, None, "name", "t", "id"), 2, 5).collect()] == [6, 7, 4, 5, 2]
    assert [r.id for r in listing.page(listing.ordered(p, "name", "asc", "name", "t", "id"), 1, 3).collect()] == [3, 9, 1]
    assert listing.search(p, "name", "").count() == 13
    assert listing.search(p, "name", "b1").count() == listing.search(p, "name", "B1", True).count() > listing.search(p, "name", "b1", True).count()
    with pytest.raises(ValueError):
        listing.page(p, 0, 10)


def test_trees(spark, rows):
    tree = trees.nodes(spark.createDataFrame([("src/main.ts",), ("src/lib/a.ts",), ("README.md",), ("maindir/x.c",)], "path string"))
    assert [r.name for r in trees.children(tree, "").collect()] == ["maindir", "src", "README.md"]
    assert rows(trees.keep_matches(tree, "main"), "path") == [("maindir",), ("src",), ("src/main.ts",)]
    assert trees.keep_matches(tree, "  ").count() == tree.count()
    assert rows(trees.readme(tree), "path") == [("README.md",)]
    assert rows(trees.cap_depth(tree, 3), "path") == [("README.md",), ("maindir",), ("maindir/x.c",), ("src",), ("src/lib",), ("src/main.ts",)]
    fresh = spark.createDataFrame([("src/lib", "src", "lib", 2, False), ("src/new.ts", "src", "new.ts", 2, True)], tree.schema)
    assert rows(trees.refresh(tree, "src", fresh), "path") == [("README.md",), ("maindir",), ("maindir/x.c",), ("src",), ("src/lib",), ("src/lib/a.ts",), ("src/new.ts",)]


def test_tree_changes(spark, rows):
    tree = spark.createDataFrame([("a", False), ("a/x.c", True), ("ab.c", True), ("a/x.o", True)], "path string, is_file boolean")
    assert rows(dml.rename(tree, "a", "z"), "path") == [("ab.c",), ("z",), ("z/x.c",), ("z/x.o",)]
    assert rows(dml.remove(tree, "a"), "path") == [("ab.c",)]
    assert dml.remove(tree, "none").count() == 4
    assert dml.create(tree, "a/x.c", True).count() == 4 and dml.create(tree, "a/y.c", True).count() == 5
    assert rows(dml.without_artifacts(tree), "path") == [("a",), ("a/x.c",), ("ab.c",)]


def test_changes(spark, rows):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, name string, n int")
    patched = dml.patch(base, spark.createDataFrame([(2, None, 7)], base.schema), "id")
    assert rows(patched) == [(1, "a", 5), (2, "b", 7)]
    assert dml.seed(base, base).count() == 2 and dml.seed(base.limit(0), base).count() == 2
    made = dml.insert(spark.createDataFrame([("k", "x")], "id string, name string"), spark.createDataFrame([("y",)], "name string"), "id")
    assert made.filter("length(id) = 36").count() == 1
    history = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, 3), ("k", 3, "b", None)], "key string, ts int, intent string, passed int")
    assert rows(dml.merge_patches(history, "key", "ts", ["intent", "passed"])) == [("k", "b", 3, 3)]


def test_joins(spark, rows):
    left = spark.createDataFrame([("src/a", "a"), ("src/b", "b"), ("src/c", "c"), ("src/d", "d")], "full string, short string")
    right = spark.createDataFrame([("src/a", "a", "1"), ("inc/b", "b", "2"), ("x/c", "c", "3"), ("y/c", "c", "4")], "full string, short string, h string")
    assert rows(joins.fallback_unique(left, right, "full", "short", "h"), "full", "h") == [("src/a", "1"), ("src/b", "2"), ("src/c", None), ("src/d", None)]
    points = spark.createDataFrame([("f", 1), ("f", 5), ("f", 9), ("g", 3)], "file string, line int")
    starts = spark.createDataFrame([("f", 4, "one"), ("f", 9, "two"), ("h", 1, "no")], "file string, begin int, name string")
    assert rows(joins.enclosing(points, starts, "file", "line", "begin", ["begin", "name"])) == [("f", 1, None, None), ("f", 5, 4, "one"), ("f", 9, 9, "two"), ("g", 3, None, None)]
    zipped = joins.zipped(spark.createDataFrame([(1, [("a.c",), ("b.c",)], ["x/a.c"])], "id int, files array<struct<orig string>>, names array<string>"), "files", "names", "orig")
    assert rows(zipped, "place", "name") == [(0, "x/a.c"), (1, "b.c")]
    tasks = spark.createDataFrame([(1, "p"), (2, "q")], "id int, project string")
    assert rows(joins.left_default(tasks, spark.createDataFrame([("p", "P")], "project string, title string"), "project", {"title": "未知项目"}), "id", "title") == [(1, "P"), (2, "未知项目")]


def test_containing(spark, rows):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    texts = [(k, " ".join(word() for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(60, None), (3, "x a b c y"), (61, "")]
    items = [(k, " ".join(word() for _ in range(k % 7))) for k in range(40)] + [(40, None), (41, "a b c"), (42, "")]
    got = joins.containing(spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(items, "i int, item string"), "t", "text", "item")
    want = sorted(((t, i) for t, x in texts for i, y in items if x is not None and y is not None and y in x), key=repr)
    assert rows(got, "t", "i") == want and len(want) > 200


def test_containing_with_null_keys(spark, rows):
    texts = spark.createDataFrame([(1, "one two three four"), (None, "zero two three four five"), (None, "none"), (2, None)], "k int, t string")
    items = spark.createDataFrame([("o two three f",), ("on",)], "item string")
    assert rows(joins.containing(texts, items, "k", "t", "item"), "k", "item") == sorted([(None, "o two three f"), (None, "on"), (1, "on")], key=repr)


def test_changes_with_owners_and_nulls(spark, rows):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "id int, name string, n int")
    patches = spark.createDataFrame([(1, 1, None, 9, ["name", "n"]), (1, 2, "z", None, ["name"]), (2, 1, None, None, []), (3, 1, "c", None, ["n", "name"])], "id int, by int, name string, n int, named array<string>")
    assert rows(dml.patch(base, patches, "id", "by", "named")) == [(1, "z", 9), (2, "b", 6), (3, "c", None)]
    parents = spark.createDataFrame([(1, "u", 2), (2, "v", 1)], "p int, owner string, n int")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "c int, p int")
    asked = spark.createDataFrame([(10, "u"), (10, "u"), (12, "u"), (99, "u")], "c int, user string")
    left, kept = dml.delete_owned(parents, children, asked, "p", "c", "owner", "user", "n")
    assert rows(left) == [(1, "u", 1), (2, "v", 1)] and rows(kept, "c") == [(11,), (12,)]


def test_ignore_patterns(spark, rows):
    paths_ = [("a.log",), ("keep.log",), ("d/x.log",), ("build/k/a.c",), ("src/build/a.c",), ("doc/a/b/c.md",), ("doc/c.md",), ("t1.c",), ("t2.c",), ("tx.c",), (".git/x",), ("out",), ("d/out/y",), ("a+b",)]
    frame = spark.createDataFrame(paths_, "path string")
    left = lambda *p: [r[0] for r in rows(files.not_ignored(frame, list(p)), "path")]
    every = sorted(p[0] for p in paths_ if p[0] != ".git/x")
    assert left() == left("# none", "") == every
    assert left("*.log", "!keep.log") == [p for p in every if not p.endswith(".log") or p == "keep.log"]
    assert left("/build/", "!build/k/a.c") == [p for p in every if not p.startswith("build/")]
    assert left("doc/**/c.md") == [p for p in every if not p.endswith("c.md")] and left("doc/*/c.md") == every
    assert left("t[0-9].c") == [p for p in every if p not in ("t1.c", "t2.c")] and left("t[!0-9].c") == [p for p in every if p != "tx.c"]
    assert left("out/") == [p for p in every if p != "d/out/y"] and left("a+b") == [p for p in every if p != "a+b"]


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_root_ignore_file_as_git(spark, rows, tmp_path):
    """A written tree with its own ignore file, against ``git check-ignore``."""
    rules = "# built\n*.o\n!keep.o\n/build/\nlog/**/x.txt\nt[0-2].c\n\\#odd\nout/\ndeep/*.tmp\n"
    names = ["a.o", "keep.o", "sub/keep.o", "sub/b.o", "build/a.c", "src/build/a.c", "log/x.txt", "log/a/b/x.txt", "t1.c", "t3.c", "sub/t2.c", "#odd", "out/y", "sub/out/y", "deep/z.tmp", "deep/er/z.tmp", "file out"]
    for name, content in [(n, "x") for n in names] + [(".gitignore", rules), ("sub/.gitignore", "")]:
        at = tmp_path / "tree" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    subprocess.run(["git", "init", "-q", str(tmp_path / "tree")], check=True)
    ignored = subprocess.run(["git", "-C", str(tmp_path / "tree"), "check-ignore", "--no-index", *names], capture_output=True, text=True).stdout.split("\n")
    ignored = {n.strip('"') for n in ignored}
    kept = sorted((n,) for n in names if n not in ignored)
    assert 3 < len(kept) < len(names) and rows(files.scan_not_ignored(spark, str(tmp_path / "tree")), "path") == kept
    tree = spark.createDataFrame([(n, b"x") for n in names] + [(".gitignore", rules.encode()), (".git/x", b"")], "path string, content binary")
    assert rows(files.not_ignored_by_root(tree), "path") == sorted([*kept, (".gitignore",)])
    assert files.not_ignored_by_root(tree.filter("path <> '.gitignore'")).count() == len(names)
    assert files.root_rules(spark, str(tmp_path)) == []


def test_flatten(spark, rows):
    data = [("m", "A", 1, 20), ("m", "b", 2, 8), ("m", "c", 3, 5), ("m", "d", 9, 12), ("m", "E", 21, 30), ("n", "x", 1, 1), ("n", "y", 1, 9)]
    got = trees.flatten(spark.createDataFrame(data, "f string, name string, s int, e int"), "f", "name", "s", "e").collect()
    assert [(r.name, r.indent) for r in got] == [("A", 0), ("b", 1), ("c", 2), ("d", 1), ("E", 0), ("y", 0), ("x", 1)]


def test_windows(spark, rows):
    w = spark.createDataFrame([("a", i, c) for i, c in enumerate([0, 1, 1, -1, -1, -1])], "g string, i int, c int")
    assert rows(windows.first_closed(windows.running(w, "g", ["i"], F.col("c")), "g", "i")) == [("a", 4)]
    assert rows(windows.chunks(spark.createDataFrame([(600,), (0,)], "size long"), "size", 256)) == [(0, 0, 0, True), (600, 0, 256, False), (600, 256, 256, False), (600, 512, 88, True)]


def test_graph(spark, rows):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("c", "a"), ("b", "b"), ("a", "<operator>.plus")], "src string, dst string")
    down = graph.within_hops(calls, F.col("node") == "a", 3)
    assert rows(down) == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    text_ = graph.dot(graph.call_edges(calls)).first()[0]
    assert text_.startswith("digraph") and '"a" -> "b";' in text_ and "operator" not in text_
    info = graph.calls_of(spark.createDataFrame([("a",), ("z",)], "name string"), graph.call_edges(calls), spark.createDataFrame([("a", "x", "local"), ("a", "x", "param")], "method string, name string, kind string"))
    assert rows(info) == [("a", ["b"], ["x"]), ("z", [], [])]


def test_streams(spark, rows):
    chunks = spark.createDataFrame([("s", 0, '{"type":"content","v":"a'), ("s", 1, 'b"}\n\n{bad}\n{"type":"do'), ("s", 2, 'ne","v":"x"}')], "id string, seq int, chunk string")
    assert rows(streams.ndjson(chunks, "id", "seq", "chunk", "type string, v string"), "type", "v") == [("content", "ab"), ("done", "x")]
    lines = spark.createDataFrame([("s", 0, 'data: {"a":1}'), ("s", 1, ""), ("s", 2, "data: {bad"), ("s", 3, ": note"), ("s", 4, "data: [DONE]"), ("s", 5, 'data: {"a":2}'), ("t", 0, 'data: {"a":3}')], "id string, seq int, line string")
    assert rows(streams.sse(lines, "id", "seq", "line"), "id", "payload") == [("s", '{"a":1}'), ("t", '{"a":3}')]


def test_dashboard(spark, rows):
    one = spark.range(1)
    assert tuple(one.select(dashboard.ring(F.lit(1000), F.lit(850), F.lit(800)).alias("r")).first()[0]) == (800, 50, 150)
    assert one.select(dashboard.radar(F.array().cast("array<double>")).alias("r")).first()[0] == [0.0] * 6
    states = spark.createDataFrame([("passed",), ("failed",), ("ignored",), ("pending",)], "status string")
    assert rows(dashboard.ordered_status_counts(states, "status")) == [(1, 2, 1, 4)]
    series = dashboard.parallel(spark.createDataFrame([("b", 2.0), ("a", 1.0)], "name string, value double"), "name", ["name", "value"]).first()
    assert (series["name"], series["value"]) == (["a", "b"], [1.0, 2.0])


LCOV = """TN:x
SF:/w/a.c
FN:1,f
FN:10,g
FNDA:3,f
FNDA:0,g
DA:2,3
DA:3,0
DA:11,0
DA:3,1
BRDA:2,0,0,1
BRDA:2,0,1,-
BRDA:40,0,0,5
end_of_record
SF:/w/unity.c
DA:1,1
end_of_record
SF:/w/b.c
FN:7,h
BRDA:900,0,0,2
end_of_record
"""


def test_lcov(spark, rows):
    rec = coverage.records(spark.createDataFrame([("t", LCOV)], "file string, content string"))
    assert rows(coverage.by_file(rec), "source", "line_total", "line_covered", "function_total", "function_covered", "branch_total", "branch_covered") == [("/w/a.c", 3, 2, 2, 1, 3, 2), ("/w/b.c", 0, 0, 1, 0, 1, 1)]
    got = rows(coverage.by_function(rec), "name", "start_line", "end_line", "line_total", "line_covered", "line_rate", "branch_total", "branch_covered", "branch_rate")
    assert got == [("f", 1, 9, 2, 2, 1.0, 2, 1, 0.5), ("g", 10, 11, 1, 0, 0.0, 0, 0, 1.0), ("h", 7, 1007, 0, 0, 1.0, 1, 1, 1.0)]
    assert {r.source: r.lines for r in coverage.line_map(rec).collect()} == {"/w/a.c": {2: 3, 3: 1, 11: 0}}


def model_of_lcov(text_):
    """Plain Python reading of one record: [(name, start, end, lines, hit lines, branches, hit branches)]."""
    fn, order, lines, branches = {}, {}, {}, []
    for line in text_.split("\n"):
        kind, _, rest = line.partition(":")
        v = rest.split(",")
        if kind == "FN":
            fn[v[1]] = int(v[0])
            order.setdefault(v[1], len(order))
        elif kind == "DA":
            lines[int(v[0])] = int(v[1])
        elif kind == "BRDA":
            branches.append((int(v[0]), 0 if v[3] == "-" else int(v[3])))
    names = sorted(fn, key=lambda n: (fn[n], order[n]))
    out = []
    for i, n in enumerate(names):
        end = fn[names[i + 1]] - 1 if i + 1 < len(names) else max(lines) if lines else fn[n] + 1000
        mine = [c for k, c in lines.items() if fn[n] <= k <= end]
        own = [c for k, c in branches if fn[n] <= k <= end]
        out.append((n, fn[n], end, len(mine), sum(c > 0 for c in mine), len(own), sum(c > 0 for c in own)))
    return sorted(out)


def test_lcov_random(spark, rows):
    rng, texts = random.Random(5), []
    for k in range(25):
        parts = [f"FN:{rng.randint(1, 60)},f{rng.randint(0, 4)}" for _ in range(rng.randint(1, 5))]
        parts += [f"DA:{rng.randint(1, 80)},{rng.randint(0, 2)}" for _ in range(rng.randint(0, 30))]
        parts += [f"BRDA:{rng.randint(1, 90)},0,0,{rng.choice(['-', '0', '2'])}" for _ in range(rng.randint(0, 15))]
        rng.shuffle(parts)
        texts.append((f"t{k}", "\n".join([f"SF:/w/{k}.c", *parts, "end_of_record"])))
    got = coverage.by_function(coverage.records(spark.createDataFrame(texts, "file string, content string")))
    found = {}
    for r in got.collect():
        found.setdefault(r.file, []).append((r.name, r.start_line, r.end_line, r.line_total, r.line_covered, r.branch_total, r.branch_covered))
    assert {k: sorted(v) for k, v in found.items()} == {k: model_of_lcov(t) for k, t in texts}


def test_c_functions():
    code = "int add(int a, int b) {\n  return a + b;\n}\n\nint sub(int a, int b)\n\n{\n  if (a) { return 1; }\n  return a - b;\n}\nint proto(int);\nif (x) {\n}\nstatic inline long one(void) { return 1; }\nint odd(void)\n;\n{\n}\nchar * s(void) { return \"}\"; }\n"
    found = list(c_source.find_functions(code))
    assert [(n, a, b) for n, a, b, _ in found] == [("add", 1, 3), ("sub", 5, 10), ("one", 14, 14), ("s", 19, 19)]
    assert found[0][3] == "int add(int a, int b)"


def test_targets(spark, rows):
    f = "int {n}(int a) {{\n return a;\n}}\n"
    data = [
        ("m/a.c", f.format(n="a1") + "static " + f.format(n="a2")), ("m/a.h", "int a1(int a);"), ("m/b.c", f.format(n="b1")), ("inc/b.h", "/* int b1(int a); */"),
        ("m/c.c", f.format(n="c1")), ("x/c.h", "int c1(int a);"), ("y/c.h", ""), ("m/d.c", f.format(n="d1")), ("cfg.json", "{}"),
    ]
    src = spark.createDataFrame(data, "path string, content string")
    targets = c_source.test_targets(src)
    assert rows(targets, "name", "category", "reason") == [("a1", "must", None), ("a2", "optional", "internal_static"), ("b1", "must", "not_declared_in_header"), ("c1", "must", "no_corresponding_header"), ("d1", "must", "no_corresponding_header")]
    assert rows(c_source.target_counts(targets)) == [(4, 1, 0, 5)]
    results = spark.createDataFrame([("m/a.c::a1", "t", True, 3, 0, 0, 0.5, 0.5), ("m/b.c::b1", "t", None, 1, 0, 0, 0.9, 0.1)], "k string, latest_task_id string, compile_success boolean, passed int, failed int, ignored int, line_coverage double, branch_coverage double")
    results = results.select(F.md5("k").alias("result_key"), "*").drop("k")
    summary = c_source.test_summary(targets, results, text.path_key(F.col("source_file"), F.col("name"))).collect()
    assert [(r.name, r.status) for r in summary] == [("b1", "passed"), ("a1", "passed"), ("c1", "pending"), ("d1", "pending")]
    shape = {r.path: [x.name for x in r.functions] for r in c_source.structure(src, c_source.functions(src.filter("path like '%.c'"))).collect()}
    assert shape["m/a.c"] == ["a1", "a2"] and shape["cfg.json"] == []


def test_repairs(spark):
    code = """#include "unity.h"
__attribute__((weak)) int mock(void) {
  if (1) { return 0; }
}

static int mock_calls = 0;
void test_a(void) {
  TEST_ASSERT(1);
}
void test_b(void) {
  if (x) { TEST_IGNORE_MESSAGE("no"); }
}
int main(void) {
  RUN_TEST(test_a);
  RUN_TEST(test_b);
}"""
    src = spark.createDataFrame([(1, code), (2, "int a;"), (3, "")], "id int, code string")
    kept = {r.id: r.code for r in c_source.strip_ignored_tests(src).collect()}
    assert "test_b" not in kept[1] and "RUN_TEST(test_a)" in kept[1] and kept[1].count("{") == kept[1].count("}") and kept[2] == "int a;" and kept[3] == ""
    bare = {r.id: r.code for r in c_source.strip_weak_mocks(src).collect()}
    assert "mock" not in bare[1] and bare[1].startswith('#include "unity.h"\nvoid test_a')
    names = [(r.line, r.name, r.kind) for r in c_source.outline(spark.createDataFrame([(1, "class A:\n  def b():\nlet c = 1")], "id int, code string")).collect()]
    assert names == [(1, "A", "class"), (2, "b", "function"), (3, "c", "variable")]


def test_files(spark, rows, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/main.ts").write_text("x")
    (tmp_path / "README.md").write_text("# hello")
    (tmp_path / "meta.json").write_text("{}")
    (tmp_path / "big.txt").write_bytes(("é" * 600_000).encode())
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("p/a.c", "int a;")
        z.writestr("p/b.txt", "b")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    tree = files.scan(spark, str(tmp_path)).cache()
    assert [r.path for r in files.listing(tree).collect()][:2] == ["src", "a.png"]
    read = {r.path: r for r in files.read(tree).collect()}
    assert read["README.md"].content == "# hello" and read["big.txt"].status == 413 and read["a.png"].content_base64 == "iVBORw=="
    cut = files.ranged(tree.filter("path = 'big.txt'"), 1, 4).first()
    assert (cut["text"], cut["limit"], cut["eof"]) == ("\ufffdé\ufffd", 4, False)
    assert files.ranged(tree.filter("path = 'README.md'"), 5, 100).first()["eof"]
    entries = files.zip_entries(tree.filter("path like '%.zip'"))
    assert rows(entries, "archive", "path", "length") == [("z.zip", "p/a.c", 6), ("z.zip", "p/b.txt", 1)]
    assert rows(files.archive_summary(tree.filter("path like '%.zip'"), entries), "archive", "c_files", "files") == [("bad.zip", 0, 0), ("z.zip", 1, 2)]
    assert [r.path for r in files.code_files(tree).collect()] == []
    assert files.upload_errors(tree).count() == 0
    assert rows(files.not_ignored(tree, ["*.zip", "/src/", "# note"]), "path") == [("README.md",), ("a.png",), ("big.txt",), ("meta.json",)]
    packed = sinks.zipped(tree.filter("path like 'src/%'").withColumn("folder", F.lit("f"))).first()
    assert zipfile.ZipFile(io.BytesIO(packed["archive"])).namelist() == ["src/main.ts"]
    sinks.write_text(tree.filter("path = 'README.md'").select(files.text_of(F.col("content")).alias("t")), "t", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "# hello"
    assert spark.range(1).select(files.text_dropping(F.lit(bytearray(b"a\xffb")))).first()[0] == "ab"


def test_documents_of_design(spark, rows):
    one = '{"function_design": {"basic_info": {"function_name": " f ", "function_desc": "%s"}}}'
    data = [("a.json", one % "old"), ("b.json", "[" + one % "new" + "," + '{"function_design": {"basic_info": {"function_name": "g"}}}' + "]"), ("meta.json", one % "meta"), ("c.json", "{broken"), ("d.json", "{}")]
    docs = files.design_documents(spark.createDataFrame([(p, bytearray(c.encode())) for p, c in data], "path string, content binary"))
    assert rows(docs.select("name", "path", "doc.basic_info.function_desc")) == [("f", "b.json", "new"), ("g", "b.json", None)]
    assert rows(files.has_any(docs)) == [(True,)] and rows(files.has_any(docs.limit(0))) == [(False,)]
    index = files.item_index(spark.createDataFrame([("p/i/x.c",), ("q/i/y.c",), (".h/j/x",), ("top.c",)], "path string"))
    assert rows(index) == [("i", "q/i")]
    assert rows(files.symbols(spark.createDataFrame([("o", "main T 0 1\nx U\nhelp t 4\n")], "file string, content string"))) == [("o", "help"), ("o", "main")]
    assert tuple(spark.range(1).select(files.json_or(F.lit("{x"), "a int", '{"a": 5}').alias("v")).first()[0]) == (5,)
    raw = '{"project_name": "p", "target_coverage_idx": 3, "rag_references": [[0.5, "c", "t"], [1, "d", "u"]]}'
    refs = files.references(spark.createDataFrame([(raw,)], "raw string")).first()
    assert refs["target_coverage_idx"] == 3 and [tuple(r) for r in refs["rag_references"]] == [(0.5, "c", "t"), (1.0, "d", "u")]


def test_scratch_needs_a_shared_folder(spark):
    """On a cluster a folder of one machine would lose rows."""
    from types import SimpleNamespace

    from millrace.session import scratch_root

    def session(master, **found):
        conf = SimpleNamespace(get=lambda name, default=None: found.get(name.rpartition(".")[2], default))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert scratch_root(session("local[8]")).startswith("file:/") and scratch_root(session("yarn", dir="hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,100]"):
        with pytest.raises(ValueError):
            scratch_root(session(master))


def test_package_zip(tmp_path):
    """Another Python can import the package from the zip file alone."""
    import subprocess
    import sys

    from millrace.session import package_zip

    path = package_zip(str(tmp_path / "millrace.zip"))
    code = f"import sys; sys.path.insert(0, {path!r}); import millrace.operators.joins as j; print(j.__file__)"
    assert path in subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).stdout
