"""Joins, sets and changes."""

from pyspark.sql import functions as F

from millrace.functions import status, text
from millrace.operators import dml, graph, joins
from millrace.plans.registry import query


@query("semi_auth", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def semi_auth(t):
    items = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.present(t("orders").select("o_orderkey", "o_custkey"), items, "o_orderkey")


@query(
    "item_in_project",
    "SELECT c_custkey, n_name, count(*) AS items, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY c_custkey, n_name",
)
def item_in_project(t):
    items = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("p"))
    orders = t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    rows = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("items"), F.round(F.sum("p"), 2).alias("price"))
    people = t("customer").select("c_custkey", "c_nationkey").join(t("nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.join(people, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "n_name", "items", "price")


@query(
    "left_default",
    "SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def left_default(t):
    known = t("labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), "toxic")
    return joins.left_default(t("documents").select("doc_id"), known, "doc_id", {"label": "unknown", "toxic": -1})


@query(
    "fallback_unique_join",
    """
    WITH c AS (SELECT page_id, regexp_extract(url, '://(?:www\\.|m\\.|blog\\.)?([^/]*)', 1) AS host, regexp_extract(url, '://(?:www\\.|m\\.|blog\\.)?([^./]*)', 1) AS short FROM pages),
    h AS (SELECT page_id, concat(host, CASE WHEN page_id % 2 = 0 THEN '' ELSE '.old' END) AS host, short FROM c),
    f AS (SELECT host, min(page_id) AS a FROM h GROUP BY host), s AS (SELECT short, min(page_id) AS b FROM h GROUP BY short HAVING count(*) = 1)
    SELECT c.page_id, coalesce(a, b) AS header FROM c LEFT JOIN f ON f.host = c.host LEFT JOIN s ON s.short = c.short
    """,
)
def fallback_unique_join(t):
    # Each page looks for a header among all pages, of which every other one is known by another host.
    host, short = r"://(?:www\.|m\.|blog\.)?([^/]*)", r"://(?:www\.|m\.|blog\.)?([^./]*)"
    rows = t("pages").select("page_id", F.regexp_extract("url", host, 1).alias("host"), F.regexp_extract("url", short, 1).alias("short"))
    heads = rows.select(F.col("page_id").alias("header"), F.concat("host", F.when(F.col("page_id") % 2 == 0, "").otherwise(".old")).alias("host"), "short")
    return joins.fallback_unique(rows, heads, "host", "short", "header").select("page_id", "header")


@query(
    "regex_theta_join",
    "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
def regex_theta_join(t):
    return joins.containing(t("documents").select("doc_id", "text"), t("benchmark").select("item_id", F.col("text").alias("item")), "doc_id", "text", "item").select("item_id", "doc_id")


@query(
    "left_cache_join",
    """
    WITH l AS (SELECT md5(concat(user_id, '::', event_type)) AS k, max(ts) AS last_ts, arg_max(value, ts) AS last_value FROM events GROUP BY 1)
    SELECT c_custkey, coalesce(last_value, 0) AS last_value, last_ts FROM customer LEFT JOIN l ON l.k = md5(concat(c_custkey, '::', 'purchase'))
    """,
)
def left_cache_join(t):
    key = text.path_key(F.col("user_id").cast("string"), F.col("event_type"))
    last = t("events").groupBy(key.alias("k")).agg(F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value"))
    people = t("customer").select("c_custkey", text.path_key(F.col("c_custkey").cast("string"), F.lit("purchase")).alias("k"))
    return joins.left_default(people, last, "k", {"last_value": 0.0}).select("c_custkey", "last_value", "last_ts")


@query(
    "interval_join",
    """
    WITH s AS (SELECT user_id, ts AS start_ts, event_id AS start_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_ts FROM events WHERE event_type = 'signup')
    SELECT e.event_id, s.start_id FROM events e LEFT JOIN s ON s.user_id = e.user_id AND e.ts >= s.start_ts AND (s.next_ts IS NULL OR e.ts < s.next_ts)
    """,
)
def interval_join(t):
    starts = t("events").filter("event_type = 'signup'").select("user_id", F.col("ts").alias("start_ts"), F.col("event_id").alias("start_id"))
    return joins.enclosing(t("events").select("event_id", "user_id", "ts"), starts, "user_id", "ts", "start_ts", ["start_id"]).select("event_id", "start_id")


@query(
    "first_enclosing",
    "SELECT o_orderkey, min(l_linenumber) AS first_line, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate GROUP BY o_orderkey",
)
def first_enclosing(t):
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    rows = t("orders").select("o_orderkey", "o_orderdate").join(items, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")))
    return rows.groupBy("o_orderkey").agg(F.min("l_linenumber").alias("first_line"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))


@query("tri_state_hits", "SELECT d.doc_id, CASE WHEN toxic IS NULL THEN 'none' WHEN toxic > 0 THEN 'hit' ELSE 'missed' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def tri_state_hits(t):
    rows = t("documents").select("doc_id").join(t("labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.select("doc_id", status.tri_state(F.col("toxic")).alias("state"))


@query(
    "ordered_equi_join",
    "SELECT e.event_id, e.user_id, f.first_at FROM events e JOIN (SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'signup' GROUP BY user_id) f ON f.user_id = e.user_id WHERE e.event_type = 'purchase' AND e.ts > f.first_at",
)
def ordered_equi_join(t):
    rows = t("events").select("event_id", "user_id", "ts", "event_type")
    return joins.after_first(rows, "user_id", "ts", F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id", "user_id", "first_at")


@query(
    "priority_source",
    """
    WITH u AS (SELECT c_nationkey AS k, 0 AS priority, c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier UNION ALL SELECT n_nationkey, 2, n_nationkey FROM nation)
    SELECT k, priority, min(id) AS id FROM u WHERE (k, priority) IN (SELECT k, min(priority) FROM u GROUP BY k) GROUP BY k, priority
    """,
)
def priority_source(t):
    first = t("customer").filter("c_acctbal < 0").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_custkey").alias("id"))
    second = t("supplier").select(F.col("s_nationkey").cast("long").alias("k"), F.col("s_suppkey").alias("id"))
    third = t("nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_nationkey").cast("long").alias("id"))
    return joins.by_priority([first, second, third], "k", "id").select(F.col("k").cast("int").alias("k"), "priority", "id")


@query("anti_missing", "SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(t):
    orders = joins.missing(t("orders").select(F.col("o_orderkey").alias("id")), t("lineitem").select(F.col("l_orderkey").alias("id")), "id")
    docs = joins.missing(t("documents").select(F.col("doc_id").alias("id")), t("labels").select(F.col("doc_id").alias("id")), "id")
    return orders.select(F.lit("order").alias("kind"), "id").unionByName(docs.select(F.lit("document").alias("kind"), "id"))


@query(
    "missing_headers",
    r"""
    WITH d AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS text FROM documents),
    c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\bthat\b', 'va_list', 'g'), '\bare\b', 'free', 'g') AS code FROM d)
    SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(code, '\b(va_list|va_start|va_end|va_arg)\b') AND NOT contains(code, '#include <stdarg.h>') THEN '<stdarg.h>' END,
      CASE WHEN regexp_matches(code, '\b(memcpy|memset|memmove|strcmp|strncmp|strlen|strcpy|strncpy|strstr|strchr)\b') THEN '<string.h>' END,
      CASE WHEN regexp_matches(code, '\b(malloc|calloc|realloc|free|atoi|atof|atol|exit|abort)\b') THEN '<stdlib.h>' END,
      CASE WHEN regexp_matches(code, '\bptrdiff_t\b') THEN '<stddef.h>' END) AS headers FROM c
    """,
)
def missing_headers(t):
    code = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), r"\bthat\b", "va_list"), r"\bare\b", "free")
    return t("documents").select("doc_id", F.array_join(text.missing_headers(code), ",").alias("headers"))


@query("insert_union", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation")
def insert_union(t):
    new = t("nation").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return dml.insert(t("region").select("r_regionkey", "r_name"), new, "r_regionkey")


@query(
    "patch_update",
    "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
)
def patch_update(t):
    rows = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    patches = rows.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment"), F.when(F.col("c_custkey") % 20 == 0, 0.0).alias("c_acctbal"))
    return dml.patch(rows, patches, "c_custkey")


@query(
    "patch_null",
    """
    WITH p AS (SELECT l_orderkey AS k, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN n > 5 THEN NULL ELSE o_orderpriority END AS o_orderpriority, CASE WHEN n IS NULL OR n = 1 THEN o_totalprice ELSE n::DOUBLE END AS o_totalprice FROM orders LEFT JOIN p ON k = o_orderkey
    """,
)
def patch_null(t):
    # A patch for each item: from the second on they set the price, from the sixth on they clear the priority; the last line wins.
    line = F.col("l_linenumber")
    named = F.concat(F.when(line > 1, F.array(F.lit("o_totalprice"))).otherwise(F.array().cast("array<string>")), F.when(line > 5, F.array(F.lit("o_orderpriority"))).otherwise(F.array().cast("array<string>")))
    patches = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), line.alias("by"), F.lit(None).cast("string").alias("o_orderpriority"), line.cast("double").alias("o_totalprice"), named.alias("named"))
    return dml.patch(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), patches, "o_orderkey", "by", "named")


@query(
    "cascade_delete",
    "SELECT 'order' AS kind, o_orderkey AS id, 0 AS line FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT 'item', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)",
)
def cascade_delete(t):
    gone = t("orders").filter("o_custkey % 7 = 0").select("o_orderkey")
    orders, items = dml.cascade(t("orders"), t("lineitem"), gone, "o_orderkey", "l_orderkey")
    first = orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(0).alias("line"))
    return first.union(items.select(F.lit("item"), "l_orderkey", "l_linenumber"))


@query("rename_prefix", r"SELECT page_id, CASE WHEN path = 'en' OR starts_with(path, 'en/') THEN concat('english', substr(path, 3)) ELSE path END AS path FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages)")
def rename_prefix(t):
    tree = t("pages").select("page_id", F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1).alias("path"))
    return dml.rename(tree, "en", "english")


@query(
    "json_merge_latest",
    "SELECT user_id, arg_max(value, ts) FILTER (event_type = 'purchase') AS last_purchase, arg_max(value, ts) FILTER (event_type = 'error') AS last_error, max(ts) AS updated_at FROM events GROUP BY user_id",
)
def json_merge_latest(t):
    patch = lambda kind, name: F.when(F.col("event_type") == kind, F.col("value")).alias(name)
    history = t("events").select("user_id", "ts", patch("purchase", "last_purchase"), patch("error", "last_error"))
    return dml.merge_patches(history, "user_id", "ts", ["last_purchase", "last_error"])


@query("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("ordered_distinct", "SELECT word, min(pos) - 1 AS first_pos FROM (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT string_split(text, ' ') AS ws FROM documents)) GROUP BY word")
def ordered_distinct(t):
    words = t("documents").select(F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return words.groupBy("word").agg(F.min("pos").cast("long").alias("first_pos"))


@query("set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def set_difference(t):
    returned = t("lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return t("part").select(F.col("p_partkey").alias("k")).distinct().join(returned, "k", "left_anti")


@query(
    "graph_3hop",
    """
    WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey),
    d1 AS (SELECT * FROM e WHERE src = 1), d2 AS (SELECT * FROM e WHERE src IN (SELECT dst FROM d1)), d3 AS (SELECT * FROM e WHERE src IN (SELECT dst FROM d2)),
    u1 AS (SELECT * FROM e WHERE dst = 1), u2 AS (SELECT * FROM e WHERE dst IN (SELECT src FROM u1)), u3 AS (SELECT * FROM e WHERE dst IN (SELECT src FROM u2))
    SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM (FROM d1 UNION FROM d2 UNION FROM d3 UNION FROM u1 UNION FROM u2 UNION FROM u3)
    """,
)
def graph_3hop(t):
    edges = t("lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return graph.within_hops(edges, F.col("node") == "1", 3)


@query(
    "graph_reach",
    """
    WITH RECURSIVE e AS (
      SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, CASE WHEN doc_id % 50 = 49 THEN doc_id - 49 ELSE doc_id + 1 END AS dst FROM documents UNION ALL SELECT doc_id, n_chars FROM documents) WHERE src <> dst),
    down(node, depth) AS (SELECT DISTINCT src, 0 FROM e WHERE src = 7 UNION SELECT dst, depth + 1 FROM down JOIN e ON src = node WHERE depth < 8),
    up(node, depth) AS (SELECT DISTINCT src, 0 FROM e WHERE src = 7 UNION SELECT src, depth + 1 FROM up JOIN e ON dst = node WHERE depth < 8)
    SELECT 'down' AS way, node::VARCHAR AS node, min(depth)::INT AS depth FROM down GROUP BY node UNION ALL SELECT 'up', node::VARCHAR, min(depth)::INT FROM up GROUP BY node
    """,
)
def graph_reach(t):
    # Rings of fifty documents, with a link to the one that has a document's length as its number.
    k = F.col("doc_id")
    after = F.when(k % 50 == 49, k - 49).otherwise(k + 1)
    edges = t("documents").select(k.cast("string").alias("src"), F.explode(F.array(after.cast("string"), F.col("n_chars").cast("string"))).alias("dst"))
    return graph.reached(edges, F.col("node") == "7", 8)
