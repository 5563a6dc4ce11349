"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, media, numbers, paths, status, text


@pytest.fixture(scope="module")
def one(spark):
    base = spark.range(1)
    return lambda *columns: tuple(base.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_paths(one):
    p = F.lit("src/app/Main.Test.TS")
    assert one(paths.basename(p), paths.dirname(p), paths.extension(p), paths.stem(p), paths.first_segment(p), paths.depth(p)) == ("Main.Test.TS", "src/app", "ts", "src/app/Main.Test", "src", 3)
    assert one(paths.dirname(F.lit("a")), paths.node_extension(F.lit(".env")), paths.node_extension(F.lit("x.ENV")), paths.node_extension(F.lit("noext"))) == ("", "", ".env", "")
    assert one(paths.archive_name(F.lit("a.tar.gz")), paths.archive_name(F.lit(".zip")), paths.first_dot_name(F.lit("a.tar.gz")), paths.join_path(F.lit(""), F.lit("x"))) == ("a.tar", ".zip", "a", "x")
    assert one(paths.prefixes(F.lit("a/b/c")))[0] == ["a", "a/b", "a/b/c"]


def test_paths_stay_inside(one):
    base = F.lit("base/item")
    assert one(*[paths.inside(base, F.lit(p)) for p in ("base/item", "base/item/x", "base/item/../item/x", "base/item2/x", "base/item/../../x", "../base/item", "base/./item")]) == (True, True, True, False, False, False, True)


def test_kinds(one):
    kinds = [media.kind_of(F.lit(p)) for p in ("script.py", "a.PNG", ".env", "x.env", "noext")]
    assert [tuple(k) for k in one(*kinds)] == [("text/x-python", "python", False), ("image/png", "plaintext", True), ("application/octet-stream", "plaintext", True), ("text/plain", "plaintext", False), ("application/octet-stream", "plaintext", True)]
    assert one(media.editor_language(F.lit("src/index.ts")), media.editor_language(F.lit("docs/readme.md")), media.editor_language(F.lit("a.rs"))) == ("typescript", "markdown", "plaintext")
    assert one(*[media.preview(F.lit(m)) for m in ("image/png", "application/pdf", "application/zip", "")]) == ("image", "pdf", "other", "none")
    assert one(media.is_binary(F.lit("a.7Z")), media.is_binary(F.lit("a.tar"))) == (True, False)


def test_numbers(one):
    assert one(*[text.parse_int_or(F.lit(v), 10) for v in ("12abc", "0", "", "x", " -3")]) == (12, 10, 10, 10, -3)
    assert one(numbers.rate(F.lit(0), F.lit(0)), numbers.rate(F.lit(1), F.lit(4)), numbers.percent(F.lit(1), F.lit(8)), numbers.percent(F.lit(0), F.lit(0))) == (1.0, 0.25, 13, 100)
    assert one(*[numbers.coverage_bucket(F.lit(v).cast("double")) for v in (None, 0, 0.8, 0.5, 0.1)]) == ("none", "none", "high", "medium", "low")
    assert one(*[numbers.human_size(F.lit(v).cast("long")) for v in (None, 0, 1023, 1024, 1 << 20, 5 << 30)]) == ("-", "0 B", "1023 B", "1.00 KB", "1.00 MB", "5.00 GB")
    assert one(numbers.progress(F.lit(8), F.lit(16)), numbers.progress(F.lit(16), F.lit(16)), numbers.pages(F.lit(13), 12)) == (55, 100, 2)


def test_values_with_units(one):
    v = lambda x, u: numbers.value_unit(F.lit(x).cast("double"), u)
    assert one(v(85.5, "分"), v(None, "分"), v(12, "个"), v(92.5, "%"), v(3, "天"), v(2.25, "小时")) == ("85.5 分", "- -", "12 个", "92.5%", "3 天", "2.3 小时")


def test_c_text(one):
    code = "int f(int a, char *b) {\n  int x = 1;\n  if (a) { return g(a); }\n  return x;\n}"
    graph = one(text.code_graph(F.lit(code)))[0]
    assert (graph["variables"], graph["calls"], graph["returns"]) == (["a", "b", "x"], ["f", "g"], ["g(a)", "x"])
    assert one(text.strip_comments(F.lit("a /* x\ny */ b // c\nd")))[0] == "a  b \nd"
    assert one(text.strip_static(F.lit("static int f;\nstatic inline int g;")))[0] == "int f;\nstatic inline int g;"
    assert one(text.fenced(F.lit("x\n```c\nint a;\n```\ny")), text.fenced(F.lit("plain")), text.strip_fences(F.lit("```c\na\n```"))) == ("int a;", "plain", "\na\n")
    assert one(text.top_level_names(F.lit("int main(void) {\n}\nstatic void helper (int a) {\n  if (a) x();\n}\nint main(void);")))[0] == ["main", "helper"]
    assert one(text.complexity(F.lit("a")), text.complexity(F.lit(code)), text.branch_tokens(F.lit("a&&b if (x && y)"))) == ("LOW", "MED", 2)


def test_headers_are_added_after_the_last_include(one):
    code = "#include <stdio.h>\n#include <string.h>\nint f() { free(strlen(s)); }"
    assert one(text.missing_headers(F.lit(code)))[0] == ["<stdlib.h>"]
    assert one(text.add_headers(F.lit(code)))[0] == "#include <stdio.h>\n#include <string.h>\n#include <stdlib.h>\nint f() { free(strlen(s)); }"
    assert one(text.add_headers(F.lit("int a;")), text.add_headers(F.lit("va_list v;"))) == ("int a;", "#include <stdarg.h>\nva_list v;")


def test_ids_come_back(one):
    path = "ü/" + "a" * 100 + "_b.c"
    value = text.encode_id(F.lit(path), F.lit(17))
    coded = one(value)[0]
    assert "\n" not in coded and "+" not in coded and "/" not in coded
    assert one(*text.decode_id(F.lit(coded))) == (path, 17)


def test_marks_and_lines(one):
    assert one(text.mark(F.lit("A.b a.B axb"), "a.b"))[0] == "<mark>A.b</mark> <mark>a.B</mark> axb"
    assert one(text.insert_after(F.lit("a\nb x\nc"), "x", "// n"))[0] == "a\nb x\n// n\nc"
    assert one(text.operator_signs(F.lit("<operator>.fieldAccess <operator>.cast")))[0] == ". (cast)"


def test_design_text(spark):
    from millrace.sources.files import DESIGN

    doc = '{"basic_info": {"function_name": "f", "function_desc": "adds"}, "io_params": {"input_params": [{"param_name": "a", "param_desc": "x"}]}, "call_relation": {"called_functions": ["g", "h"]}}'
    got = spark.range(1).select(text.design_text(F.from_json(F.lit(doc), DESIGN)).alias("t")).first()[0]
    assert got.split("\n")[1:] == ["- Function Name: f", "- Identifier: ", "- Description: adds", "- Input Parameters:", "    - a: x", "- Called Functions: g, h"]


def test_statuses(one):
    s = lambda task, ok, p, f, i: status.test_status(F.lit(task), F.lit(ok).cast("boolean"), F.lit(p), F.lit(f), F.lit(i))
    assert one(s(None, None, 0, 0, 0), s("t", False, 1, 0, 0), s("t", True, 1, 1, 0), s("t", None, 1, 0, 1), s("t", True, 0, 0, 1), s("t", True, 0, 0, 0)) == ("pending", "compile_error", "failed", "passed", "ignored", "no_tests")
    assert one(*[status.valid_name(F.lit(n)) for n in ("DetailProject", "Test Project", "项目_1", "x" * 65, "")]) == (True, False, True, False, False)
    assert one(status.exactly_one(F.lit(True), F.lit(False), F.lit(False)), status.exactly_one(F.lit(True), F.lit(True), F.lit(False))) == (True, False)
    assert tuple(one(status.outcome_counts(F.lit("a:PASS\nb:PASS\nc:FAIL\nd:IGNORE"), F.lit(1)))[0]) == (2, 1, 1, 4)
    assert tuple(one(status.outcome_counts(F.lit("boom"), F.lit(-11)))[0]) == (0, 1, 0, 1)
    e = lambda err, run, p, ok, t: status.execution_title(F.lit(err), F.lit(run), F.lit(p), F.lit(ok).cast("boolean"), F.lit(t))
    assert one(e("x", False, 0, None, False), e(None, True, 10, None, False), e(None, True, 60, None, False), e(None, False, 0, False, True), e(None, False, 0, True, True), e(None, False, 0, None, False)) == ("执行出错", "正在编译测试用例", "正在执行测试并收集数据", "编译失败", "执行完成", "准备就绪")
    c = lambda ok, f, o, r: status.failure_context(F.lit(ok), F.lit(f), F.lit(o), F.lit(r), "no build", "no run")
    assert one(c(False, 0, "o", ""), c(True, 2, "o", "r"), c(True, 2, "", "r"), c(True, 0, "o", "r")) == ("no build", "o", "no run", None)


def test_maps_and_windows(one):
    assert one(arrays.put(F.create_map(F.lit("a"), F.lit(1)), F.lit("a"), F.lit(2)))[0] == {"a": 2}
    assert one(arrays.windows(F.split(F.lit("a b c b c d"), " "), 2))[0] == ["a b", "b c", "c b", "c d"]
    assert one(arrays.windows(F.split(F.lit("a"), " "), 2))[0] == []


def test_missing_headers_work_their_code_out_once(spark):
    found = spark.createDataFrame([(1, "FREE(p); VA_LIST x;"), (2, None), (3, "")], "id int, code string").select("id", text.missing_headers(F.lower("code")).alias("h"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert {r.id: r.h for r in found.collect()} == {1: ["<stdarg.h>", "<stdlib.h>"], 2: [], 3: []}
