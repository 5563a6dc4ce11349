"""Blocks of lines against models that walk line by line, with starts inside blocks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import c_source
from millrace.operators.blocks import Lines


def walk_functions(content):
    """The chosen functions by the rules of the walk, from the module's own walker."""
    return [(a, b, n, s) for n, a, b, s in c_source.find_functions(content)]


def block_end(lines, i):
    depth, opened = 0, False
    for k in range(i, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        opened = opened or "{" in lines[k]
        if opened and depth <= 0:
            return k
    return len(lines)


def model_weak(code):
    lines, out, i = code.split("\n"), [], 0
    while i < len(lines):
        weak = "__attribute__((weak))" in lines[i]
        body = re.search(r"[a-zA-Z_]\w*\s*\(", lines[i]) and "{" in lines[i]
        if weak and (body or any("{" in x for x in lines[i + 1 : i + 4])):
            i = block_end(lines, i) + 1
            while i < len(lines) and not lines[i].strip():
                i += 1
            continue
        if not re.match(r"^\s*static\s+.*\bmock_\w+\s*=", lines[i]):
            out.append(lines[i])
        i += 1
    return "\n".join(out)


def model_ignored(code):
    lines, owner, gone = code.split("\n"), None, set()
    for line in lines:
        head = re.match(r"^\s*void\s+(test_\w+)\s*\(", line)
        owner = head[1] if head else owner
        if "TEST_IGNORE_MESSAGE" in line and owner:
            gone.add(owner)
    out, i = [], 0
    while i < len(lines):
        head, run = re.match(r"^\s*void\s+(test_\w+)\s*\(", lines[i]), re.match(r"^\s*RUN_TEST\(\s*(\w+)\s*\)", lines[i])
        if head and head[1] in gone:
            i = block_end(lines, i) + 1
            continue
        if not (run and run[1] in gone):
            out.append(lines[i])
        i += 1
    return "\n".join(out)


PIECES = [
    "__attribute__((weak)) int m(void) {", "__attribute__((weak)) int n(void)", "__attribute__((weak)) int p;", "{", "}", "  if (x) {", "} else {", "{ }", "  call(a);", "", "   ", "static int mock_a = 1;", "}}", "{{",
    "void test_a(void) {", "void test_b(void)", "  TEST_IGNORE_MESSAGE(\"no\");", "  RUN_TEST(test_a);", "RUN_TEST( test_b );", "int f(int a) {", "int g(int a)", "long * h(void)", "unsigned  long q (int a, char b) { return 1; }", "int *r(int a) {", "int s * (a) {",
    "// int c(a) {", "#define X(a) {", "while (a) {", "return f(a) {", ";", "x {", "a * * b(c) {", "word word", "f(a) {", "struct t u(v) {{{",
]


@pytest.fixture(scope="module")
def codes(spark):
    rng = random.Random(11)
    rows = [(i, "\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, 45)))) for i in range(250)]
    rows += [(1000, "\n".join(["int f(int a) {"] * 40 + ["}"] * 39)), (1001, "int f(int a) {\n" * 30 + "}\n" * 60), (1002, None), (1003, "")]
    return spark.createDataFrame(rows, "id int, code string").repartition(4).cache()


@pytest.mark.parametrize("limit", [None, 40])
def test_functions_equal_the_walk(codes, limit):
    found = c_source.functions(codes, "id", "code", walked=0, limit=limit) if limit is None else c_source.functions_of_lines(codes, "id", "code", limit)
    got = sorted((int(r.source_file), r.start_line, r.end_line, r.name, r.signature) for r in found.collect())
    want = sorted((r.id, *f) for r in codes.collect() if r.code for f in walk_functions(r.code))
    assert len(want) > 150 and got == want


@pytest.mark.parametrize("limit", [None, 40])
def test_repairs_equal_the_walk(codes, limit):
    for strip, model in ((c_source.strip_weak_mocks, model_weak), (c_source.strip_ignored_tests, model_ignored)):
        got = {r.id: r.code for r in strip(codes, limit=limit).collect()}
        want = {r.id: model(r.code or "") for r in codes.collect()}
        assert sum(want[r.id] != r.code for r in codes.collect()) > 30
        assert got == want


def test_short_texts_are_repaired_without_a_shuffle(spark, monkeypatch):
    """Short texts are walked in their tasks, long ones spread; both give the same, odd white space and letters included."""
    odd = ["static int\r é mock_a = 1;", "static int \rmock_a = 1;", "static int émock_a = 1;", "static int e\u0301mock_a = 1;", "static \u0301mock_a =", "static ½mock_a =", "static int\u2028mock_b = 2;", "\u00a0static int mock_c;", "static int x_mock_d = 1; mock_e =", "static mock_mock_f="]
    texts = ["\n".join(random.Random(k).choice(PIECES + odd) for _ in range(30)) for k in range(40)] + ["\n".join(odd), None, ""]
    codes = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(texts)], "id int, code string")
    for strip in (c_source.strip_weak_mocks, c_source.strip_ignored_tests):
        found = strip(codes)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.id, r.code) for r in found.collect() if r.id is not None)
        monkeypatch.setattr(c_source, "WALKED", 300)
        mixed = sorted((r.id, r.code) for r in strip(codes).collect() if r.id is not None)
        assert got == mixed == sorted((r.id, r.code) for r in strip(codes, limit=40).collect() if r.id is not None)
        monkeypatch.undo()


def test_starts_inside_a_block(spark):
    code = "__attribute__((weak)) int a(void) {\n__attribute__((weak)) int b(void) {\n}\n  tail();\n}\nint keep;"
    assert c_source.strip_weak_mocks(spark.createDataFrame([(1, code)], "id int, code string")).first().code == "int keep;"


def test_long_chains_take_few_rounds(spark):
    # Block k is lines 2k to 2k + 3: each reaches into the next, so every second one is chosen and only steps tell.
    starts = spark.range(3000).select(F.lit("f").alias("file"), (F.col("id") * 2).cast("int").alias("at"), (F.col("id") * 2 + 3).cast("int").alias("end"))
    lines = Lines(spark.createDataFrame([("f", "\n" * 6000)], "file string, text string"), "file", "text", 500)
    assert sorted(r.at for r in lines.chosen(starts).collect()) == list(range(0, 6000, 4))


def test_a_long_file_in_several_tasks(spark):
    n = 1_000_000 // 5
    file = spark.range(1).select(F.lit("big.c").alias("path"), F.expr(f"array_join(transform(sequence(1, {n}), i -> concat('int f', i, '(int a)\n{{\n  if (a) {{\n  }}\n}}')), '\n')").alias("content"))
    found = c_source.functions(file, limit=100_000)
    assert found.count() == n
    last = found.orderBy(F.col("start_line").desc()).first()
    assert (last.name, last.start_line, last.end_line, last.signature) == (f"f{n}", 5 * n - 4, 5 * n, f"int f{n}(int a)")
    cut = Lines(file, "path", "content", 100_000)
    assert cut.slices.attach(cut.rows).groupBy("_slice").count().count() >= 9


def test_declarations(spark):
    header = "int f(int a);\n#define g(x) (x);\n// int h(void);\n/* int i(void); */\nint (*j)(void);\nextern long k (a, b)\n ;\nint l(void) { return m(1); }\nint n(int (*o)(p), q(r));\néu(v);\nint w(x;\ny(z) "
    got = c_source.declarations(spark.createDataFrame([("a.h", header), ("b.h", None), ("c.h", "f();f();")], "path string, content string"))
    names = sorted((r.header, r.name) for r in got.collect())
    patterns = [n for n in "abfghijklmnopqruvwxyz" if re.search(r"(^|[^\w])" + n + r"\s*\([^;{}]*\)\s*;", re.sub(r"(?m)^\s*#.*$", "", re.sub(r"(?m)//.*?$", "", re.sub(r"(?s)/\*.*?\*/", "", header))))]
    assert [n for h, n in names if h == "a.h" and len(n) == 1] == patterns and ("c.h", "f") in names and len([n for n in names if n[0] == "c.h"]) == 1
