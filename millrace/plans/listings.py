"""Lookups, filters, pages and aggregates."""

from pyspark.sql import functions as F

from millrace.functions import media, numbers, paths, status, text
from millrace.operators import listing, pages
from millrace.plans.registry import query


@query("point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(t):
    return listing.point(t("customer"), "c_custkey", 42)


@query("scan_filter_eq", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 77")
def scan_filter_eq(t):
    return t("orders").filter("o_custkey = 77").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("search_contains_ci", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def search_contains_ci(t):
    return listing.search(t("part"), "p_name", "AN").select("p_partkey", "p_name")


@query("paged_orders", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE contains(lower(o_orderpriority), 'h') ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20")
def paged_orders(t):
    rows = listing.search(t("orders"), "o_orderpriority", "h").select("o_orderkey", "o_orderdate", "o_totalprice")
    return listing.page(listing.ordered(rows, "date", "desc", "o_totalprice", "o_orderdate", "o_orderkey"), 3, 10)


@query(
    "deep_page",
    """
    WITH n AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id NULLS LAST) AS position, count(*) OVER () // 20 * 10 AS skipped FROM documents)
    SELECT doc_id, n_chars, position FROM n WHERE position > skipped AND position <= skipped + 10
    """,
)
def deep_page(t):
    # The page in the middle of all documents, longest first.
    rows = t("documents").select("doc_id", "n_chars")
    return pages.page(rows, [("n_chars", False), ("doc_id", True)], rows.count() // 20 + 1, 10, most=128, position="position")


@query("page_envelope", "SELECT count(*) AS total, 3 AS page, 12 AS page_limit, CAST(ceil(count(*) / 12.0) AS BIGINT) AS total_pages FROM orders WHERE o_orderstatus = 'F'")
def page_envelope(t):
    return listing.envelope(t("orders").filter("o_orderstatus = 'F'"), 3, 12)


@query("sort_dynamic_name", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 50")
def sort_dynamic_name(t):
    return listing.page(listing.ordered(t("customer").select("c_custkey", "c_name", "c_acctbal"), "name", "asc", "c_name", "c_acctbal", "c_custkey"), 1, 50).select("c_custkey", "c_name")


@query(
    "access_classify",
    """
    WITH wanted AS (SELECT DISTINCT event_id, user_id FROM events)
    SELECT event_id, CASE WHEN o.o_orderkey IS NULL THEN 404 WHEN o.o_custkey <> w.user_id THEN 403 ELSE 200 END AS code
    FROM wanted w LEFT JOIN orders o ON o.o_orderkey = w.event_id
    """,
)
def access_classify(t):
    wanted = t("events").select("event_id", "user_id").distinct()
    rows = wanted.join(t("orders").select("o_orderkey", "o_custkey"), F.col("event_id") == F.col("o_orderkey"), "left")
    return rows.select("event_id", status.access(F.col("o_orderkey").isNotNull(), F.col("o_custkey"), F.col("user_id")).alias("code"))


@query(
    "name_regex_valid",
    """
    SELECT p_partkey, regexp_matches(p_name, '^[\\x{4e00}-\\x{9fa5}a-zA-Z0-9_]+$') AND length(p_name) <= 64 AS whole_ok,
      regexp_matches(split_part(p_name, ' ', 1), '^[\\x{4e00}-\\x{9fa5}a-zA-Z0-9_]+$') AND length(split_part(p_name, ' ', 1)) <= 64 AS word_ok,
      length(p_type) <= 500 AS description_ok
    FROM part
    """.replace("\\\\", "\\"),
)
def name_regex_valid(t):
    word = F.substring_index("p_name", " ", 1)
    return t("part").select("p_partkey", status.valid_name(F.col("p_name")).alias("whole_ok"), status.valid_name(word).alias("word_ok"), status.valid_description(F.col("p_type")).alias("description_ok"))


@query("exactly_one_of", "SELECT l_returnflag, l_linestatus, (l_discount > 0.05)::INT + (l_returnflag = 'R')::INT + (l_linestatus = 'O')::INT = 1 AS ok, count(*) AS n FROM lineitem GROUP BY ALL")
def exactly_one_of(t):
    ok = status.exactly_one(F.col("l_discount") > 0.05, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return t("lineitem").groupBy("l_returnflag", "l_linestatus", ok.alias("ok")).agg(F.count("*").alias("n"))


@query("bigint_to_string", "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS owner_id FROM orders")
def bigint_to_string(t):
    return t("orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("owner_id"))


@query("conditional_columns", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS closed_price, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS open_priority FROM orders")
def conditional_columns(t):
    done = F.col("o_orderstatus") == "F"
    return t("orders").select("o_orderkey", F.when(done, F.col("o_totalprice")).alias("closed_price"), F.when(~done, F.col("o_orderpriority")).alias("open_priority"))


@query("exclude_patterns", "SELECT doc_id, source FROM documents WHERE NOT starts_with(source, 'src1') AND NOT contains(text, 'Licensed') AND NOT contains(text, 'the of')")
def exclude_patterns(t):
    return t("documents").filter(~F.startswith("source", F.lit("src1")) & ~F.contains("text", F.lit("Licensed")) & ~F.contains("text", F.lit("the of"))).select("doc_id", "source")


@query("flag_gated_union", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'must' ELSE 'optional' END AS category FROM orders WHERE o_orderstatus IN ('F', 'O')")
def flag_gated_union(t):
    part = lambda s: t("orders").filter(F.col("o_orderstatus") == s).select("o_orderkey")
    return listing.gated_union(part("F"), part("O"), part("P"), include_optional=True, include_skipped=False)


@query(
    "stoplist_filter",
    "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' AND w NOT IN ('if', 'while', 'for', 'switch', 'return', 'sizeof') GROUP BY w",
)
def stoplist_filter(t):
    words = t("documents").select(F.explode(F.split("text", " ")).alias("word"))
    return words.filter((F.col("word") != "") & ~F.col("word").isin(*text.CALL_STOP)).groupBy("word").agg(F.count("*").alias("n"))


@query("sum_sizes", "SELECT l_orderkey, round(sum(l_quantity), 2) AS size FROM lineitem GROUP BY l_orderkey")
def sum_sizes(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("size"))


@query("child_counts", "SELECT o_orderkey, count(l_orderkey) AS item_count, max(l_shipdate) AS last_upload FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def child_counts(t):
    counts = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last_upload"))
    rows = t("orders").select("o_orderkey").join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("item_count"), "last_upload")


_RATES = """
    WITH c AS (SELECT o_orderkey, count(l_orderkey) AS total, count(*) FILTER (l_returnflag = 'R') AS returned
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
"""


def _returned(t):
    counts = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rows = t("orders").select("o_orderkey").join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "returned")])


@query("rate_zero_default", _RATES + "SELECT o_orderkey, total, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE returned / total END AS rate FROM c")
def rate_zero_default(t):
    return _returned(t).select("o_orderkey", "total", numbers.rate(F.col("returned"), F.col("total")).alias("rate"))


@query("percent_round", _RATES + "SELECT o_orderkey, CAST(CASE WHEN total = 0 THEN 100 ELSE floor(returned / total * 100 + 0.5) END AS BIGINT) AS percent FROM c")
def percent_round(t):
    return _returned(t).select("o_orderkey", numbers.percent(F.col("returned"), F.col("total")).alias("percent"))


@query("category_counts", "SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1")
def category_counts(t):
    return t("customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n"))


@query(
    "status_dashboard",
    "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS passed, count(*) FILTER (event_type IN ('error', 'view')) AS failed, count(*) FILTER (event_type = 'signup') AS pending, count(*) AS total FROM events GROUP BY user_id",
)
def status_dashboard(t):
    n = lambda *k: F.count_if(F.col("event_type").isin(*k))
    return t("events").groupBy("user_id").agg(n("purchase").alias("passed"), n("error", "view").alias("failed"), n("signup").alias("pending"), F.count("*").alias("total"))


@query(
    "token_counts",
    """
    WITH c AS (SELECT doc_id, len(regexp_extract_all(text, 'the')) AS passed, len(regexp_extract_all(text, '!!')) AS f, len(regexp_extract_all(text, '%%%')) AS ignored, doc_id % 5 AS exit_code FROM documents)
    SELECT doc_id, passed, CASE WHEN exit_code <> 0 AND f = 0 THEN 1 ELSE f END AS failed, ignored, passed + CASE WHEN exit_code <> 0 AND f = 0 THEN 1 ELSE f END + ignored AS total FROM c
    """,
)
def token_counts(t):
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace("text", F.lit(":"), F.lit(";")), "the", ":PASS"), "!!", ":FAIL"), "%%%", ":IGNORE")
    return t("documents").select("doc_id", status.outcome_counts(marked, F.col("doc_id") % 5).alias("c")).select("doc_id", "c.*")


@query(
    "complexity_level",
    r"""
    WITH c AS (SELECT doc_id, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '\bthe\b', 'if', 'g'), '\bof\b', 'for', 'g'), '\b(if|else\s+if|else|for|while|do|switch|case|&&|\|\||break|continue|return)\b')) AS n
      FROM documents)
    SELECT doc_id, n::INT AS branch_tokens, CASE WHEN n <= 2 THEN 'LOW' WHEN n <= 6 THEN 'MED' ELSE 'HIGH' END AS level, CASE WHEN n <= 2 THEN 500 WHEN n <= 6 THEN 900 ELSE 1500 END AS budget FROM c
    """,
)
def complexity_level(t):
    code = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), r"\bthe\b", "if"), r"\bof\b", "for")
    rows = t("documents").select("doc_id", text.branch_tokens(code).alias("branch_tokens"), text.complexity(code).alias("level"))
    return rows.withColumn("budget", text.token_budget(F.col("level")))


@query("group_basename_list", "SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS n FROM documents GROUP BY source")
def group_basename_list(t):
    ids = F.array_sort(F.collect_list("doc_id"))
    return t("documents").groupBy("source").agg(F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.count("*").alias("n"))


@query("progress_formula", "SELECT user_id, count(*) FILTER (value > 20) AS done, CAST(least(100, 10 + floor(count(*) FILTER (value > 20) / count(*) * 90)) AS BIGINT) AS progress FROM events GROUP BY user_id")
def progress_formula(t):
    done = F.count_if(F.col("value") > 20)
    return t("events").groupBy("user_id").agg(done.alias("done"), numbers.progress(done, F.count("*")).alias("progress"))


@query(
    "batch_outcomes",
    """
    WITH b AS (SELECT user_id, event_type = 'signup' AS cancelled, event_type IN ('click', 'purchase', 'error') AS executed, event_type <> 'error' AS compiled, CASE WHEN value > 40 THEN 1 ELSE 0 END AS failed FROM events)
    SELECT count(*) FILTER (NOT cancelled AND executed AND compiled AND failed = 0) AS success, count(*) FILTER (NOT cancelled AND executed AND compiled AND failed > 0) AS failed,
      count(*) FILTER (NOT cancelled AND executed AND NOT compiled) AS compile_error, count(*) FILTER (NOT cancelled) AS generated, count(*) FILTER (NOT cancelled AND executed) AS executed, count(*) AS completed FROM b
    """,
)
def batch_outcomes(t):
    from millrace.operators.dashboard import outcome_totals

    kind = F.col("event_type")
    rows = t("events").select((kind == "signup").alias("cancelled"), F.lit(True).alias("generated"), kind.isin("click", "purchase", "error").alias("executed"), (kind != "error").alias("compiled"), F.when(F.col("value") > 40, 1).otherwise(0).alias("failed"))
    return outcome_totals(rows)


@query("size_bucket", "SELECT o_orderkey, CASE WHEN s < 1024 THEN s::DOUBLE WHEN s < 1048576 THEN s / 1024 ELSE s / 1048576 END AS size_value, CASE WHEN s < 1024 THEN 'B' WHEN s < 1048576 THEN 'KB' WHEN s < 1073741824 THEN 'MB' ELSE 'GB' END AS unit, CASE WHEN r = 0 THEN 'none' WHEN r >= 0.8 THEN 'high' WHEN r >= 0.5 THEN 'medium' ELSE 'low' END AS bucket FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 7) AS BIGINT) AS s, (o_orderkey % 11) / 10 AS r FROM orders)")
def size_bucket(t):
    size = F.floor(F.col("o_totalprice") * 7)
    value, unit = numbers.size_unit(size)
    return t("orders").select("o_orderkey", value.alias("size_value"), unit.alias("unit"), numbers.coverage_bucket((F.col("o_orderkey") % 11) / 10).alias("bucket"))


@query("parse_int_default", "SELECT c_custkey, coalesce(nullif(try_cast(nullif(regexp_extract(concat(c_custkey % 7, 'x', c_name), '^\\s*([+-]?\\d+)', 1), '') AS INT), 0), 10) AS page_limit FROM customer")
def parse_int_default(t):
    return t("customer").select("c_custkey", text.parse_int_or(F.concat((F.col("c_custkey") % 7).cast("string"), F.lit("x"), "c_name"), 10).alias("page_limit"))


@query("all_selected", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_done, bool_and(o_orderstatus = 'F') AS all_done FROM orders GROUP BY o_custkey")
def all_selected(t):
    done = F.col("o_orderstatus") == "F"
    return t("orders").groupBy("o_custkey").agg(F.bool_or(done).alias("any_done"), F.bool_and(done).alias("all_done"))


@query(
    "language_by_ext",
    r"""
    WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat(tail, '.ts') WHEN 1 THEN concat(tail, '.PY') WHEN 2 THEN concat(tail, '.png') WHEN 3 THEN concat(tail, '.md') WHEN 4 THEN '.env' ELSE tail END AS path
      FROM (SELECT page_id, regexp_extract(url, '([^/?#]+)[/]?([?#].*)?$', 1) AS tail FROM pages))
    SELECT page_id, path, CASE WHEN lower(path) LIKE '%_.ts' THEN 'text/typescript' WHEN lower(path) LIKE '%_.py' THEN 'text/x-python' WHEN lower(path) LIKE '%_.png' THEN 'image/png' WHEN lower(path) LIKE '%_.md' THEN 'text/markdown' WHEN lower(path) LIKE '%_.html' THEN 'text/html' ELSE 'application/octet-stream' END AS mime,
      CASE WHEN lower(path) LIKE '%.ts' THEN 'typescript' WHEN lower(path) LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.md' THEN 'markdown' WHEN lower(path) LIKE '%.html' THEN 'html' ELSE 'plaintext' END AS editor,
      lower(path) LIKE '%.png' AS is_binary
    FROM p
    """,
)
def language_by_ext(t):
    tail = F.regexp_extract("url", r"([^/?#]+)[/]?([?#].*)?$", 1)
    k = F.col("page_id") % 6
    path = F.when(k == 0, F.concat(tail, F.lit(".ts"))).when(k == 1, F.concat(tail, F.lit(".PY"))).when(k == 2, F.concat(tail, F.lit(".png"))).when(k == 3, F.concat(tail, F.lit(".md"))).when(k == 4, ".env").otherwise(tail)
    rows = t("pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", media.kind_of(F.col("path"))["mime"].alias("mime"), media.editor_language(F.col("path")).alias("editor"), media.is_binary(F.col("path")).alias("is_binary"))


@query(
    "path_parts",
    r"""
    WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)
    SELECT page_id, path, split_part(path, '/', -1) AS base, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(path, '([^/.])\.[^./]*$', '\1') AS stem, split_part(path, '/', 1) AS root, split_part(path, '.', 1) AS before_dot FROM p
    """,
)
def path_parts(t):
    p = F.col("path")
    rows = t("pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    return rows.select("page_id", "path", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.stem(p).alias("stem"), paths.first_segment(p).alias("root"), paths.first_dot_name(p).alias("before_dot"))
