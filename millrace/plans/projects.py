"""Projects of C sources: the test summary, structures, lookups, repairs of generated tests, and what a page shows of them."""

from pyspark.sql import functions as F

from millrace.functions import media, status, text
from millrace.operators import c_source, coverage, trees
from millrace.plans.registry import query
from millrace.plans.workflows import _LCOV_SQL, _records, _sources
from millrace.sources.files import DESIGN

_RESULTS = """
    WITH r AS (SELECT user_id, max(event_id) AS task, bool_and(value < 100) FILTER (event_type = 'error') AS compiled, count(*) FILTER (event_type = 'purchase' AND value > 60) AS passed, count(*) FILTER (event_type = 'click' AND value > 90) AS failed,
      count(*) FILTER (event_type = 'view') AS ignored, count(*) FILTER (value > 20) / count(*) AS line_coverage, count(*) FILTER (value > 40) / count(*) AS branch_coverage FROM events GROUP BY user_id)
"""


@query(
    "test_target_summary",
    _RESULTS
    + """
    SELECT concat('src/m', c_custkey, '.c') AS source_file, concat('f', c_custkey) AS name, task, CASE WHEN task IS NULL THEN 'pending' WHEN compiled = false THEN 'compile_error' WHEN failed > 0 THEN 'failed' WHEN passed > 0 THEN 'passed' WHEN ignored > 0 THEN 'ignored' ELSE 'no_tests' END AS status,
      coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(ignored, 0) AS ignored, coalesce(line_coverage, 0.0) AS line_coverage, coalesce(branch_coverage, 0.0) AS branch_coverage
    FROM customer LEFT JOIN r ON user_id = c_custkey WHERE c_custkey % 3 <> 0
    """,
)
def test_target_summary(t):
    """The must-test functions of all sources with their latest results, status and order."""
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id").cast("string")
    results = t("events").groupBy(text.path_key(F.concat(F.lit("src/m"), user, F.lit(".c")), F.concat(F.lit("f"), user)).alias("result_key")).agg(
        F.max("event_id").alias("latest_task_id"),
        F.bool_and(F.when(kind == "error", value < 100)).alias("compile_success"),
        F.count_if((kind == "purchase") & (value > 60)).alias("passed"),
        F.count_if((kind == "click") & (value > 90)).alias("failed"),
        F.count_if(kind == "view").alias("ignored"),
        (F.count_if(value > 20) / F.count("*")).alias("line_coverage"),
        (F.count_if(value > 40) / F.count("*")).alias("branch_coverage"),
    )
    out = c_source.test_summary(c_source.test_targets(_sources(t)), results, text.path_key(F.col("source_file"), F.col("name")))
    return out.select("source_file", "name", F.col("latest_task_id").alias("task"), "status", "passed", "failed", "ignored", "line_coverage", "branch_coverage")


@query("target_counts", "SELECT count(*) FILTER (c_custkey % 3 <> 0) AS must_test, count(*) FILTER (c_custkey % 3 = 0) + count(*) FILTER (c_custkey % 4 = 3) AS optional_static, 0::BIGINT AS skipped, count(*) + count(*) FILTER (c_custkey % 4 = 3) AS total FROM customer")
def target_counts(t):
    return c_source.target_counts(c_source.test_targets(_sources(t)))


@query(
    "file_structure",
    """
    SELECT concat('src/m', c_custkey, '.c') AS path, concat('f', c_custkey, CASE WHEN c_custkey % 4 = 3 THEN concat(',h', c_custkey) ELSE '' END) AS names FROM customer
    UNION ALL SELECT concat(CASE WHEN c_custkey % 5 = 0 THEN 'src/m' ELSE 'include/m' END, c_custkey, '.h'), '' FROM customer WHERE c_custkey % 5 < 3 UNION ALL SELECT concat('cfg/', n_name, '.json'), '' FROM nation
    """,
)
def file_structure(t):
    code = _sources(t)
    every = code.unionByName(t("nation").select(F.concat(F.lit("cfg/"), "n_name", F.lit(".json")).alias("path"), F.lit("int f(void) {\n}").alias("content")))
    found = c_source.functions(every.filter(~F.endswith("path", F.lit(".json"))))
    return c_source.structure(every, found).select("path", F.array_join(F.transform("functions", lambda f: f["name"]), ",").alias("names"))


@query(
    "function_lookup",
    """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 <> 0 THEN concat(replace(replace(to_base64(encode(concat('src/m', c_custkey, '.c'))), '+', '-'), '/', '_'), '_2') END AS function_id FROM customer
    """,
)
def function_lookup(t):
    # Wanted by line, right for even keys; else by name, right unless the key divides by three.
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    wanted = t("customer").select("c_custkey", F.concat(F.lit("src/m"), key, F.lit(".c")).alias("source_file"), F.when(k % 2 == 0, 2).otherwise(99).alias("start_line"), F.when(k % 3 == 0, "none").otherwise(F.concat(F.lit("f"), key)).alias("name"))
    found = c_source.functions(_sources(t).filter(F.endswith("path", F.lit(".c"))))
    return c_source.resolve(found, wanted).select("c_custkey", "function_id")


@query("code_graph", "SELECT c_custkey, concat('a,b,c', c_custkey) AS variables, concat('f', c_custkey, ',g', c_custkey, ',h') AS calls, concat('a + ', c_custkey) AS returns FROM customer")
def code_graph(t):
    key = F.col("c_custkey").cast("string")
    code = F.concat(F.lit("int f"), key, F.lit("(int a, char *b) {\n  int c"), key, F.lit(";\n  g"), key, F.lit("(a);\n  if (a) { h(b); }\n  return a + "), key, F.lit(";\n}"))
    found = t("customer").select("c_custkey", text.code_graph(code).alias("g"))
    return found.select("c_custkey", *[F.array_join(F.col(f"g.{c}"), ",").alias(c) for c in ("variables", "calls", "returns")])


@query(
    "repaired_tests",
    """
    SELECT c_custkey, concat('#include "unity.h"', chr(10), CASE WHEN c_custkey % 2 = 1 THEN concat('#include <string.h>', chr(10)) ELSE '' END, 'void test_a', c_custkey, '(void) {', chr(10), '  TEST_ASSERT(1);', chr(10), '}', chr(10),
      CASE WHEN c_custkey % 2 = 1 THEN concat('void test_b', c_custkey, '(void) {', chr(10), '  memcpy(p, q, 1);', chr(10), '}', chr(10)) ELSE '' END, 'int main(void) {', chr(10), '  RUN_TEST(test_a', c_custkey, ');', chr(10),
      CASE WHEN c_custkey % 2 = 1 THEN concat('  RUN_TEST(test_b', c_custkey, ');', chr(10)) ELSE '' END, '}') AS code FROM customer
    """,
)
def repaired_tests(t):
    # Every third has a weak function with another start inside its body.
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    weak = F.when(k % 3 == 0, F.concat(F.lit("__attribute__((weak)) int mock"), key, F.lit("(void) {\n  __attribute__((weak)) int inner(void) {\n    return 1;\n  }\n  if (1) { return 0; }\n}\n\nstatic int mock_calls = 0;\n"))).otherwise("")
    body = F.when(k % 2 == 0, '  if (x) { TEST_IGNORE_MESSAGE("no"); }\n').otherwise("  memcpy(p, q, 1);\n")
    code = F.concat(
        F.lit('#include "unity.h"\n'), weak, F.lit("void test_a"), key, F.lit("(void) {\n  TEST_ASSERT(1);\n}\nvoid test_b"), key, F.lit("(void) {\n"), body, F.lit("}\nint main(void) {\n  RUN_TEST(test_a"), key, F.lit(");\n  RUN_TEST(test_b"), key, F.lit(");\n}")
    )
    kept = c_source.strip_weak_mocks(c_source.strip_ignored_tests(t("customer").select("c_custkey", code.alias("code")), "c_custkey"), "c_custkey")
    return kept.select("c_custkey", text.add_headers(F.col("code")).alias("code"))


@query("top_level_names", "SELECT c_custkey, concat('a', c_custkey, ',b') AS names FROM customer")
def top_level_names(t):
    key = F.col("c_custkey").cast("string")
    code = F.concat(F.lit("static int a"), key, F.lit("(int x) {\n  return k(x);\n}\nvoid *b(void);\nstruct s *a"), key, F.lit("(int x);\n  int inner(void);\n"))
    return t("customer").select("c_custkey", F.array_join(text.top_level_names(code), ",").alias("names"))


@query(
    "design_text",
    """
    SELECT n_nationkey, concat('### Function Design Document (from project specification):', chr(10), '- Function Name: ', n_name, chr(10), '- Identifier: ', chr(10), '- Description: of ', n_regionkey,
      CASE WHEN n_nationkey % 2 = 0 THEN concat(chr(10), '- Input Parameters:', chr(10), '    - a: x', n_nationkey, chr(10), '    - b: y') ELSE '' END, chr(10), '- Called Functions: g, h', n_nationkey) AS shown FROM nation
    """,
)
def design_text(t):
    k = F.col("n_nationkey").cast("string")
    given = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('"io_params": {"input_params": [{"param_name": "a", "param_desc": "x'), k, F.lit('"}, {"param_name": "b", "param_desc": "y"}]}, '))).otherwise("")
    raw = F.concat(F.lit('{"basic_info": {"function_name": "'), "n_name", F.lit('", "function_desc": "of '), F.col("n_regionkey").cast("string"), F.lit('"}, '), given, F.lit('"call_relation": {"called_functions": ["g", "h'), k, F.lit('"]}}'))
    return t("nation").select("n_nationkey", text.design_text(F.from_json(raw, DESIGN)).alias("shown"))


@query(
    "execution_titles",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN '执行出错' WHEN event_type = 'click' THEN CASE WHEN value < 50 THEN '正在编译测试用例' ELSE '正在执行测试并收集数据' END WHEN event_type = 'signup' THEN '编译失败' WHEN value > 10 THEN '执行完成' ELSE '准备就绪' END AS title FROM events
    """,
)
def execution_titles(t):
    kind = F.col("event_type")
    title = status.execution_title(F.when(kind == "error", F.col("props")), kind == "click", F.col("value"), F.when(kind == "signup", False), F.col("value") > 10)
    return t("events").select("event_id", title.alias("title"))


@query("preview_kinds", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'other' ELSE 'none' END AS kind FROM customer")
def preview_kinds(t):
    k = F.col("c_custkey") % 5
    mime = F.when(k == 0, F.concat(F.lit("image/"), F.lower("c_mktsegment"))).when(k == 1, "application/pdf").when(k == 2, "text/plain").when(k == 3, "")
    return t("customer").select("c_custkey", media.preview(mime).alias("kind"))


@query(
    "failure_contexts",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value > 30 THEN props ELSE 'no build' END WHEN event_type = 'click' AND value > 20 THEN CASE WHEN value > 60 THEN concat('out ', event_id) ELSE 'no run' END END AS context FROM events",
)
def failure_contexts(t):
    kind, value = F.col("event_type"), F.col("value")
    failed = F.when((kind == "click") & (value > 20), 1).otherwise(0)
    stdout = F.when(value > 60, F.concat(F.lit("out "), F.col("event_id").cast("string"))).otherwise("")
    stderr = F.when(value > 30, F.col("props"))
    return t("events").select("event_id", status.failure_context(kind != "error", failed, stdout, stderr, "no build", "no run").alias("context"))


@query("line_map", _LCOV_SQL + "SELECT concat('/w/', user_id, '.c') AS source, string_agg(concat(line, ':', hits::BIGINT), ',' ORDER BY line) AS lines FROM l GROUP BY user_id")
def line_map(t):
    found = coverage.line_map(_records(t))
    entries = F.array_sort(F.map_entries("lines"))
    return found.select("source", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("lines"))


@query("symbol_depths", "SELECT conv_id AS file, turn::VARCHAR AS name, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE turn END::INT AS indent FROM conversations")
def symbol_depths(t):
    # In odd conversations each turn lies inside the one before, in even ones side by side.
    n, odd = F.col("turn"), F.col("conv_id") % 2 == 1
    symbols = t("conversations").select(F.col("conv_id").alias("file"), n.cast("string").alias("name"), F.when(odd, n).otherwise(n * 10).alias("first"), F.when(odd, 100_000 - n).otherwise(n * 10 + 5).alias("last"))
    return trees.flatten(symbols, "file", "name", "first", "last").select("file", "name", "indent")
