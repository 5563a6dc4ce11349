"""Whole workflows: the test summary, C sources and coverage."""

from pyspark.sql import functions as F

from millrace.functions import numbers, status
from millrace.operators import c_source, coverage
from millrace.plans.registry import query
from millrace.session import Scratch


@query(
    "status_summary",
    """
    WITH r AS (SELECT user_id, max(event_id) AS task, bool_and(NOT (event_type = 'error' AND value > 120)) AS compiled, count(*) FILTER (event_type = 'purchase' AND value > 60) AS passed,
      count(*) FILTER (event_type = 'error' AND value > 60) AS failed, count(*) FILTER (event_type = 'view' AND value > 60) AS ignored, count(*) FILTER (value > 20) AS covered, count(*) AS total FROM events GROUP BY user_id),
    s AS (SELECT c_custkey, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(ignored, 0) AS ignored,
      CASE WHEN coalesce(total, 0) = 0 THEN 0.0 ELSE covered / total END AS line_coverage,
      CASE WHEN task IS NULL THEN 'pending' WHEN NOT compiled THEN 'compile_error' WHEN failed > 0 THEN 'failed' WHEN passed > 0 THEN 'passed' WHEN ignored > 0 THEN 'ignored' ELSE 'no_tests' END AS status
      FROM customer LEFT JOIN r ON user_id = c_custkey)
    SELECT *, CASE status WHEN 'passed' THEN '通过' WHEN 'failed' THEN '失败' WHEN 'ignored' THEN '失败' WHEN 'compile_error' THEN '编译错误' WHEN 'pending' THEN '等待中' ELSE '无测试' END AS label FROM s ORDER BY line_coverage DESC, passed DESC, c_custkey
    """,
)
def status_summary(t):
    """Per customer: the latest outcome counters, a six-way status, a rate, in order. The flagship."""
    kind, high = F.col("event_type"), F.col("value") > 60
    results = t("events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.max("event_id").alias("task"),
        F.bool_and(~((kind == "error") & (F.col("value") > 120))).alias("compiled"),
        *[F.count_if((kind == k) & high).alias(n) for k, n in (("purchase", "passed"), ("error", "failed"), ("view", "ignored"))],
        F.count_if(F.col("value") > 20).alias("covered"),
        F.count("*").alias("total"),
    )
    rows = t("customer").select("c_custkey").join(results, "c_custkey", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    state = status.test_status(F.col("task"), F.col("compiled"), zero("passed"), zero("failed"), zero("ignored"))
    coverage_rate = F.when(zero("total") == 0, 0.0).otherwise(numbers.rate(zero("covered"), zero("total")))
    out = rows.select("c_custkey", zero("passed").alias("passed"), zero("failed").alias("failed"), zero("ignored").alias("ignored"), coverage_rate.alias("line_coverage"), state.alias("status"))
    out = out.withColumn("label", status.label(F.col("status"), status.STATUS_LABELS, F.col("status")))
    return out.orderBy(F.col("line_coverage").desc(), F.col("passed").desc(), "c_custkey")


def _sources(t):
    """Small C files made from the customers: a function, sometimes static, its prototype in a header for some, then a static helper, comments or nothing."""
    key = F.col("c_custkey").cast("string")
    static = F.when(F.col("c_custkey") % 3 == 0, "static ").otherwise("")
    brace = F.when(F.col("c_custkey") % 2 == 0, " {").otherwise("\n{")
    helper, notes = F.concat(F.lit("static void h"), key, F.lit("(void)\n{\n  f"), key, F.lit("(1);\n}\n")), F.lit("/* int z(int a) {\n * int y(int a) {\n */\n// int x(int a) { }\n")
    more = F.when(F.col("c_custkey") % 4 == 3, helper).when(F.col("c_custkey") % 4 == 1, notes).otherwise("")
    body = F.concat(F.lit("#include <stdio.h>\n"), static, F.lit("int f"), key, F.lit("(int a)"), brace, F.lit("\n  if (a) { return g(a); }\n  return 0;\n}\nint g"), key, F.lit("(void);\n"), more)
    c = t("customer").select(F.concat(F.lit("src/m"), key, F.lit(".c")).alias("path"), body.alias("content"))
    h = t("customer").filter("c_custkey % 5 < 3").select(
        F.concat(F.when(F.col("c_custkey") % 5 == 0, "src/m").otherwise("include/m"), key, F.lit(".h")).alias("path"),
        F.when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("/* int f"), key, F.lit("(int a); */\n"))).otherwise(F.concat(F.lit("int f"), key, F.lit("(int a);\n"))).alias("content"),
    )
    return c.unionByName(h)


_FUNCTIONS_SQL = """
    SELECT concat('src/m', c_custkey, '.c') AS source_file, concat('f', c_custkey) AS name, 2 AS start_line, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 6 END AS end_line,
      concat(CASE WHEN c_custkey % 3 = 0 THEN 'static ' ELSE '' END, 'int f', c_custkey, '(int a)') AS signature FROM customer
    UNION ALL SELECT concat('src/m', c_custkey, '.c'), concat('h', c_custkey), 8, 11, concat('static void h', c_custkey, '(void)') FROM customer WHERE c_custkey % 4 = 3
    """


@query("c_functions", _FUNCTIONS_SQL)
def c_functions(t):
    return c_source.functions(_sources(t).filter(F.endswith("path", F.lit(".c")))).drop("function_id")


@query("c_functions_by_line", _FUNCTIONS_SQL)
def c_functions_by_line(t):
    # As for files that are too long for one task: lines are dealt out, and blocks chosen by steps that double.
    return c_source.functions_of_lines(_sources(t).filter(F.endswith("path", F.lit(".c"))))


@query("declared_names", "SELECT concat(CASE WHEN c_custkey % 5 = 0 THEN 'src/m' ELSE 'include/m' END, c_custkey, '.h') AS header, concat('f', c_custkey) AS name FROM customer WHERE c_custkey % 5 < 2")
def declared_names(t):
    return c_source.declarations(_sources(t).filter(F.endswith("path", F.lit(".h"))))


@query(
    "test_targets",
    """
    SELECT concat('src/m', c_custkey, '.c') AS source_file, concat('f', c_custkey) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'optional' ELSE 'must' END AS category,
      CASE WHEN c_custkey % 3 = 0 THEN 'internal_static' WHEN c_custkey % 5 > 2 THEN 'no_corresponding_header' WHEN c_custkey % 5 = 2 THEN 'not_declared_in_header' END AS reason FROM customer
    UNION ALL SELECT concat('src/m', c_custkey, '.c'), concat('h', c_custkey), 'optional', 'internal_static' FROM customer WHERE c_custkey % 4 = 3
    """,
)
def test_targets(t):
    return c_source.test_targets(_sources(t)).select("source_file", "name", "category", "reason")


def _lcov(t):
    """One trace of LCOV text for each customer with events: a function at line 1, for even keys another at 51, lines hit by value, branches by type."""
    line, hits = (F.col("event_id") % 90 + 2).cast("string"), F.floor("value").cast("long").cast("string")
    row = F.when(F.col("event_type") == "click", F.concat(F.lit("BRDA:"), line, F.lit(",0,0,"), F.when(F.col("value") > 30, hits).otherwise("-"))).otherwise(F.concat(F.lit("DA:"), line, F.lit(","), F.when(F.col("value") > 15, hits).otherwise("0")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", row.alias("r")))), lambda x: x["r"]), "\n")
    body = t("events").groupBy("user_id").agg(text.alias("body"))
    even = F.col("user_id") % 2 == 0
    head = F.concat(F.lit("TN:\nSF:/w/"), F.col("user_id").cast("string"), F.lit(".c\nFN:1,f\n"), F.when(even, "FN:51,g\nFNDA:1,g\n").otherwise(""), F.lit("FNDA:"), (F.col("user_id") % 3).cast("string"), F.lit(",f\n"))
    return body.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("file"), F.concat(head, "body", F.lit("\nend_of_record\n")).alias("content"))


def _records(t):
    """The records as a table: several aggregates read them, and splitting and ordering the lines is the dear part."""
    lines = coverage.records(_lcov(t))
    return Scratch(lines.sparkSession, "lcov").table("records", lines)


_LCOV_SQL = """
    WITH e AS (SELECT user_id, event_id, event_id % 90 + 2 AS line, event_type = 'click' AS branch, CASE WHEN event_type = 'click' THEN CASE WHEN value > 30 THEN floor(value) ELSE 0 END ELSE CASE WHEN value > 15 THEN floor(value) ELSE 0 END END AS hits FROM events),
    l AS (SELECT user_id, line, arg_max(hits, event_id) AS hits FROM e WHERE NOT branch GROUP BY user_id, line),
    m AS (SELECT user_id, max(line) AS last_line FROM l GROUP BY user_id),
    u AS (SELECT DISTINCT user_id FROM events)
"""


@query(
    "lcov_files",
    _LCOV_SQL
    + """
    SELECT concat('/w/', u.user_id, '.c') AS source, coalesce(lt, 0) AS line_total, coalesce(lc, 0) AS line_covered, CASE WHEN coalesce(lt, 0) = 0 THEN 1.0::DOUBLE ELSE lc / lt END AS line_rate,
      CAST(CASE WHEN u.user_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS function_total, CAST((u.user_id % 2 = 0)::INT + (u.user_id % 3 > 0)::INT AS BIGINT) AS function_covered, coalesce(bt, 0) AS branch_total, coalesce(bc, 0) AS branch_covered, CASE WHEN coalesce(bt, 0) = 0 THEN 1.0::DOUBLE ELSE bc / bt END AS branch_rate
    FROM u LEFT JOIN (SELECT user_id, count(*) AS lt, count(*) FILTER (hits > 0) AS lc FROM l GROUP BY user_id) a ON a.user_id = u.user_id
      LEFT JOIN (SELECT user_id, count(*) AS bt, count(*) FILTER (hits > 0) AS bc FROM e WHERE branch GROUP BY user_id) b ON b.user_id = u.user_id
    """,
)
def lcov_files(t):
    found = coverage.by_file(_records(t))
    return found.select("source", "line_total", "line_covered", "line_rate", "function_total", "function_covered", "branch_total", "branch_covered", "branch_rate")


@query(
    "lcov_functions",
    _LCOV_SQL
    + """
    , f AS (SELECT u.user_id, 'f' AS name, 1 AS s, CASE WHEN u.user_id % 2 = 0 THEN 50 ELSE coalesce(last_line, 1001) END AS t FROM u LEFT JOIN m ON m.user_id = u.user_id UNION ALL SELECT u.user_id, 'g', 51, coalesce(last_line, 1051) FROM u LEFT JOIN m ON m.user_id = u.user_id WHERE u.user_id % 2 = 0)
    SELECT concat('/w/', f.user_id, '.c') AS source, name, CAST(s AS INT) AS start_line, CAST(t AS INT) AS end_line,
      (SELECT count(*) FROM l WHERE l.user_id = f.user_id AND line BETWEEN s AND t) AS line_total, (SELECT count(*) FROM l WHERE l.user_id = f.user_id AND line BETWEEN s AND t AND hits > 0) AS line_covered,
      (SELECT count(*) FROM e WHERE branch AND e.user_id = f.user_id AND line BETWEEN s AND t) AS branch_total, (SELECT count(*) FROM e WHERE branch AND e.user_id = f.user_id AND line BETWEEN s AND t AND hits > 0) AS branch_covered
    FROM f
    """,
)
def lcov_functions(t):
    found = coverage.by_function(_records(t))
    return found.select("source", "name", "start_line", "end_line", "line_total", "line_covered", "branch_total", "branch_covered")
