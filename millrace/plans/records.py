"""Dates, names, uploads, key-value records and single-hop graphs."""

from pyspark.sql import functions as F

from millrace.functions import dates, numbers
from millrace.operators import c_source, graph, joins, naming
from millrace.plans.registry import query
from millrace.sources import files


@query("iso_dates", "SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'Z') AS iso FROM events")
def iso_dates(t):
    return t("events").select("event_id", dates.iso(F.col("ts")).alias("iso"))


@query("locale_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS minute FROM orders")
def locale_dates(t):
    return t("orders").select("o_orderkey", dates.day(F.col("o_orderdate")).alias("day"), dates.minute(F.col("o_orderdate")).alias("minute"))


@query("dated_ids", "SELECT o_orderkey, concat('proj_', strftime(o_orderdate, '%Y%m%d'), '_', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS id FROM orders")
def dated_ids(t):
    return t("orders").select("o_orderkey", dates.dated_id("proj", F.col("o_orderdate"), F.md5(F.col("o_orderkey").cast("string"))).alias("id"))


@query("epoch_default", "SELECT c_custkey, coalesce(CAST(floor(epoch(last_ts)) AS BIGINT), 0) AS modified FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_ts FROM events WHERE event_type = 'error' GROUP BY user_id) ON user_id = c_custkey")
def epoch_default(t):
    last = t("events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_ts"))
    return t("customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", dates.epoch_or_zero(F.col("last_ts")).alias("modified"))


@query(
    "folder_upload",
    "SELECT conv_id, CAST(p AS INT) AS place, CASE WHEN p < 2 THEN concat('dir/', turn) ELSE concat('file', turn) END AS name, size, CAST(sum(size) OVER (PARTITION BY conv_id) AS BIGINT) AS upload_size FROM (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations)",
)
def folder_upload(t):
    one = F.struct("turn", F.concat(F.lit("file"), F.col("turn").cast("string")).alias("orig"), F.char_length("text").cast("long").alias("size"))
    uploads = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("files"))
    named = uploads.withColumn("names", F.transform(F.slice("files", 1, 2), lambda f: F.concat(F.lit("dir/"), f["turn"].cast("string"))))
    total = F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f["size"])
    return joins.zipped(named.withColumn("upload_size", total), "files", "names", "orig").select("conv_id", "place", "name", F.col("file.size").alias("size"), "upload_size")


@query(
    "display_names",
    """
    WITH p AS (SELECT n_nationkey, concat('proj_', n_nationkey, '_', lower(n_name)) AS id, CASE WHEN n_nationkey % 5 = 0 THEN n_name END AS given FROM nation),
    f AS (SELECT c_nationkey AS k, CASE WHEN c_nationkey % 5 = 1 THEN 'lib/a.txt' WHEN c_nationkey % 5 = 2 THEN concat('d', c_custkey % 3, '/b', c_custkey, '.c') WHEN c_nationkey % 5 = 3 THEN concat('m', c_custkey, '.c') ELSE '.git/x' END AS path FROM customer),
    d AS (SELECT k, min(s) AS dir FROM (SELECT DISTINCT k, split_part(path, '/', 1) AS s FROM f WHERE contains(path, '/') AND NOT starts_with(path, '.')) GROUP BY k HAVING count(*) = 1),
    c AS (SELECT k, min(path) AS path FROM f WHERE path LIKE '%.c' GROUP BY k)
    SELECT id, coalesce(given, dir, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE replace(path, '.c', '') END, split_part(id, '_', -1)) AS name FROM p LEFT JOIN d ON d.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey
    """,
)
def display_names(t):
    k = F.col("n_nationkey")
    projects = t("nation").select("n_nationkey", F.concat(F.lit("proj_"), k.cast("string"), F.lit("_"), F.lower("n_name")).alias("id"), F.when(k % 5 == 0, F.col("n_name")).alias("given"))
    key, r = F.col("c_custkey").cast("string"), F.col("c_nationkey") % 5
    path = F.when(r == 1, "lib/a.txt").when(r == 2, F.concat(F.lit("d"), (F.col("c_custkey") % 3).cast("string"), F.lit("/b"), key, F.lit(".c"))).when(r == 3, F.concat(F.lit("m"), key, F.lit(".c"))).otherwise(".git/x")
    held = t("customer").select(F.col("c_nationkey").alias("n_nationkey"), path.alias("path")).join(projects.select("n_nationkey", "id"), "n_nationkey").select("id", "path")
    return naming.display_names(projects.select("id", "given"), held)


@query(
    "one_hop_calls",
    """
    WITH c AS (SELECT DISTINCT user_id, event_type FROM events), v AS (SELECT DISTINCT user_id, concat('v', event_id % 4) AS name FROM events WHERE value > 30)
    SELECT CAST(c_custkey AS VARCHAR) AS name, coalesce((SELECT string_agg(event_type, ',' ORDER BY event_type) FROM c WHERE c.user_id = c_custkey), '') AS calls,
      coalesce((SELECT string_agg(v.name, ',' ORDER BY v.name) FROM v WHERE v.user_id = c_custkey), '') AS variables FROM customer
    """,
)
def one_hop_calls(t):
    user = F.col("user_id").cast("string")
    found = graph.calls_of(
        t("customer").select(F.col("c_custkey").cast("string").alias("name")),
        graph.call_edges(t("events").select(user.alias("src"), F.col("event_type").alias("dst"))),
        t("events").filter("value > 30").select(user.alias("method"), F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")).alias("name")),
    )
    return found.select("name", F.array_join("calls", ",").alias("calls"), F.array_join("variables", ",").alias("variables"))


@query(
    "symbol_outline",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(concat('class ', replace(text, chr(10), concat(chr(10), '  def '))), chr(10))) AS line, generate_subscripts(string_split(concat('class ', replace(text, chr(10), concat(chr(10), '  def '))), chr(10)), 1) AS n FROM documents)
    SELECT doc_id, CAST(n AS INT) AS line, regexp_extract(line, '^\s*(?:class|function|def|interface|const|let|var)\s+([a-zA-Z0-9_]+)', 1) AS name, CASE WHEN contains(line, 'class') THEN 'class' WHEN contains(line, 'function') OR contains(line, 'def') THEN 'function' WHEN contains(line, 'interface') THEN 'interface' ELSE 'variable' END AS kind
    FROM l WHERE regexp_matches(line, '^\s*(?:class|function|def|interface|const|let|var)\s+([a-zA-Z0-9_]+)')
    """,
)
def symbol_outline(t):
    code = t("documents").select("doc_id", F.concat(F.lit("class "), F.replace("text", F.lit("\n"), F.lit("\n  def "))).alias("code"))
    return c_source.outline(code, "doc_id", "code")


@query("value_units", "SELECT p_partkey, concat(p_size, ' 个') AS count_shown, concat(p_size, '%') AS percent_shown, CASE WHEN p_size % 9 = 0 THEN '- -' ELSE concat(p_size, ' 天') END AS days_shown FROM part")
def value_units(t):
    size = F.col("p_size").cast("double")
    return t("part").select("p_partkey", numbers.value_unit(size, "个").alias("count_shown"), numbers.value_unit(size, "%").alias("percent_shown"), numbers.value_unit(F.when(F.col("p_size") % 9 != 0, size), "天").alias("days_shown"))


@query("json_kv_default", "SELECT event_id, CASE WHEN event_type = 'error' THEN 7 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_kv_default(t):
    value = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    return t("events").select("event_id", files.json_or(value, "k long", '{"k": 7}')["k"].alias("k"))


@query("upload_percent", "SELECT o_orderkey, CAST(floor((o_orderkey % 97) * 100 / 97 + 0.5) AS BIGINT) AS percent FROM orders")
def upload_percent(t):
    return t("orders").select("o_orderkey", numbers.percent(F.col("o_orderkey") % 97, F.lit(97)).alias("percent"))


@query("task_filter", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 17 AND event_type <> 'view' ORDER BY ts DESC, event_id")
def task_filter(t):
    return t("events").filter("user_id = 17 AND event_type <> 'view'").orderBy(F.col("ts").desc(), "event_id").select("event_id", "user_id", "event_type")
