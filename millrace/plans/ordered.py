"""Queries on ordered rows, streams of chunks and trees."""

from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators import dashboard, joins, listing, scans, streams, trees, windows
from millrace.plans.registry import query


@query("lead_intervals", "SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, event_id + 1000) AS interval_end FROM events")
def lead_intervals(t):
    return windows.intervals(t("events").select("user_id", "event_id"), "user_id", "event_id", F.col("event_id") + 1000).select("event_id", "interval_end")


@query("segment_running", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM events")
def segment_running(t):
    return windows.segments(t("events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "segment")


@query(
    "running_balance_first_nonpos",
    """
    WITH b AS (SELECT user_id, ts, sum(CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS balance FROM events),
    o AS (SELECT *, max(CASE WHEN balance > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS opened FROM b)
    SELECT user_id, min(CASE WHEN opened = 1 AND balance <= 0 THEN ts END) AS closed_at FROM o GROUP BY user_id
    """,
)
def running_balance_first_nonpos(t):
    change = F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(-1)
    return windows.first_closed(windows.running(t("events").select("user_id", "ts", "event_type"), "user_id", ["ts"], change), "user_id", "ts")


@query("lookahead5", "SELECT event_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) = 1 AS seen_ahead FROM events")
def lookahead5(t):
    return windows.ahead(t("events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "seen_ahead")


@query("last_include", "SELECT conv_id, coalesce(max(CASE WHEN role = 'assistant' THEN turn END), -1) AS last_place FROM conversations GROUP BY conv_id")
def last_include(t):
    return windows.last_marker(t("conversations"), "conv_id", "turn", F.col("role") == "assistant")


@query("latest_per_key", "SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY user_id, event_type")
def latest_per_key(t):
    return joins.latest(t("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("stale_responses", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stale_responses(t):
    return streams.newest_response(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("nearest_preceding", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nearest FROM events")
def nearest_preceding(t):
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return windows.nearest_before(t("events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], value).select("event_id", "nearest")


def _third(t):
    """The events by a key that holds a third of them, and the rows beyond which a group is cut: a 64th of all."""
    rows = t("events").select("event_id", "ts", "event_type", "value", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("k"))
    return rows, max(1000, rows.count() // 64)


_THIRD = "(SELECT event_id, ts, event_type, value, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k FROM events)"


@query(
    "hot_key_running",
    f"""
    SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment, CAST(sum(CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END) OVER w AS BIGINT) AS balance,
      last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS nearest FROM {_THIRD} WINDOW w AS (PARTITION BY k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """,
)
def hot_key_running(t):
    rows, limit = _third(t)
    change = F.when(F.col("event_type").isin("view", "signup"), 1).otherwise(-1)
    nearest = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    found = scans.scan(rows, "k", ["ts", "event_id"], limit=limit, segment=scans.Total((F.col("event_type") == "signup").cast("int")), balance=scans.Total(change), nearest=scans.Latest(nearest))
    return found.select("event_id", "segment", "balance", "nearest")


@query(
    "hot_key_ahead",
    f"""
    SELECT event_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) = 1 AS seen_ahead,
      coalesce(lead(event_id) OVER (PARTITION BY k ORDER BY event_id) - 1, event_id + 1000) AS interval_end FROM {_THIRD}
    """,
)
def hot_key_ahead(t):
    rows, limit = _third(t)
    seen = windows.ahead(rows, "k", ["ts", "event_id"], F.col("event_type") == "error", limit=limit)
    return windows.intervals(seen, "k", "event_id", F.col("event_id") + 1000, limit=limit).select("event_id", "seen_ahead", "interval_end")


@query(
    "hot_key_enclosing",
    f"SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, event_type <> 'signup', event_id ROWS UNBOUNDED PRECEDING) AS start_id FROM {_THIRD} QUALIFY event_type <> 'signup'",
)
def hot_key_enclosing(t):
    rows, limit = _third(t)
    starts = rows.filter("event_type = 'signup'").groupBy("k", "ts").agg(F.max("event_id").alias("start_id"))
    return joins.enclosing(rows.filter("event_type <> 'signup'"), starts.withColumnRenamed("ts", "start_ts"), "k", "ts", "start_ts", ["start_id"], limit=limit).select("event_id", "start_id")


@query("target_first_order", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant') DESC, turn) AS INT) AS rank FROM conversations")
def target_first_order(t):
    return listing.target_first(t("conversations").select("conv_id", "turn", "role"), F.col("role") == "assistant", "turn", "conv_id").select("conv_id", "turn", "rank")


@query(
    "chunk_offsets",
    "SELECT doc_id, o AS chunk_offset, greatest(least(256, n_chars - o), 0) AS chunk_length, o + greatest(least(256, n_chars - o), 0) >= n_chars AS eof FROM (SELECT doc_id, n_chars, unnest(generate_series(0, greatest(n_chars - 1, 0), 256)) AS o FROM documents)",
)
def chunk_offsets(t):
    return windows.chunks(t("documents").select("doc_id", "n_chars"), "n_chars", 256).select("doc_id", "chunk_offset", "chunk_length", "eof")


@query("ring_buffer_200", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def ring_buffer_200(t):
    return listing.newest(t("events").select("event_id", "ts"), "ts", "event_id")


_PATHS = r"SELECT regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/$', '') AS path FROM pages"
_NODES = f"""
    WITH RECURSIVE f AS (SELECT DISTINCT path FROM ({_PATHS})),
    p AS (SELECT path AS full_path, string_split(path, '/') AS parts FROM f),
    e AS (SELECT full_path, array_to_string(parts[1:i], '/') AS path FROM p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
    n AS (SELECT path, bool_or(path = full_path) AS is_file, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, split_part(path, '/', -1) AS name, len(string_split(path, '/'))::INT AS depth FROM e GROUP BY path)
"""


def _tree(t):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/$", "")
    return trees.nodes(t("pages").select(path.alias("path")).distinct())


@query("url_prefixes", _NODES + "SELECT path, parent, name, depth, is_file FROM n")
def url_prefixes(t):
    return _tree(t)


@query("children_of", _NODES + "SELECT path, name, is_file FROM n WHERE parent = '' ORDER BY is_file, lower(name), name")
def children_of(t):
    return trees.children(_tree(t), "").select("path", "name", "is_file")


@query("tree_filter_ancestors", _NODES + ", h AS (SELECT path FROM n WHERE contains(lower(name), '7')) SELECT DISTINCT n.path, n.is_file FROM n JOIN h ON h.path = n.path OR starts_with(h.path, concat(n.path, '/'))")
def tree_filter_ancestors(t):
    return trees.keep_matches(_tree(t), " 7 ").select("path", "is_file")


@query("depth_cap", _NODES + "SELECT depth, count(*) AS n FROM n WHERE depth < 3 GROUP BY depth")
def depth_cap(t):
    return trees.cap_depth(_tree(t), 3).groupBy("depth").agg(F.count("*").alias("n"))


@query("first_leaf", _NODES + "SELECT split_part(path, '/', 1) AS root, min(path) AS first_path FROM n WHERE is_file GROUP BY 1")
def first_leaf(t):
    return trees.first_leaf(_tree(t), paths.first_segment(F.col("path")))


@query("reassemble_chunks", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def reassemble_chunks(t):
    return streams.reassemble(t("conversations"), "conv_id", "turn", "text")


@query(
    "ndjson_reframe",
    "SELECT user_id, event_id, event_type FROM events",
)
def ndjson_reframe(t):
    # Each user's events as JSON lines, in streams of a thousand ids, cut into chunks of 17 characters wherever that falls, and framed again.
    line = F.concat(F.to_json(F.struct("event_id", "event_type")), F.lit("\n"))
    rows = t("events").select(F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 1000)).alias("stream"), "event_id", line.alias("line"))
    whole = rows.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "").alias("w"))
    cut = whole.select("stream", "w", F.explode(F.sequence(F.lit(0), F.floor((F.length("w") - 1) / 17).cast("int"))).alias("seq"))
    chunks = cut.select("stream", "seq", F.substring("w", F.col("seq") * 17 + 1, F.lit(17)).alias("chunk"))
    # Each stream ends in a broken-off line, which a reader drops.
    chunks = chunks.unionByName(whole.select("stream", F.lit(2**31 - 1).alias("seq"), F.lit('{"event_id": -1, "event_type": "cut"}').alias("chunk")))
    found = streams.ndjson(chunks, "stream", "seq", "chunk", "event_id long, event_type string", unfinished=False)
    return found.select(F.substring_index("stream", "-", 1).cast("long").alias("user_id"), "event_id", "event_type")


@query(
    "sse_filter",
    "SELECT user_id, event_id, props AS payload FROM events e WHERE event_type <> 'click' AND event_id < coalesce((SELECT min(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 40), 1e18)",
)
def sse_filter(t):
    end = (F.col("event_type") == "error") & (F.col("value") > 40)
    line = F.when(end, "data: [DONE]").when(F.col("event_type") == "click", F.concat(F.lit(": "), "props")).otherwise(F.concat(F.lit("data: "), "props"))
    return streams.sse(t("events").select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line")


@query("debounce_last", "SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events) WHERE following IS NULL OR epoch_us(following) - epoch_us(ts) > 36000000000")
def debounce_last(t):
    rows = t("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return windows.debounced(rows, "user_id", "ts", 36_000).select("event_id", "user_id")


@query("ring_series", "SELECT count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS not_passed, count(*) FILTER (o_orderstatus = 'P') AS not_run FROM orders")
def ring_series(t):
    n = lambda *s: F.count_if(F.col("o_orderstatus").isin(*s))
    totals = t("orders").agg(F.count("*").alias("total"), n("F", "O").alias("completed"), n("F").alias("passed"))
    return totals.select(dashboard.ring(F.col("total"), F.col("completed"), F.col("passed")).alias("r")).select("r.*")


@query("trend_pivot", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS passed FROM events GROUP BY 1 ORDER BY 1")
def trend_pivot(t):
    kind = F.col("event_type")
    return dashboard.trend(t("events"), F.to_date("ts"), kind == "error", kind == "purchase")


@query(
    "radar_vector",
    "SELECT " + ", ".join(f"count(*) FILTER (event_type = '{k}') / count(*) AS {k}_rate" for k in ("click", "error", "purchase", "signup", "view")) + ", 0.0::DOUBLE AS other_rate FROM events",
)
def radar_vector(t):
    kinds = ("click", "error", "purchase", "signup", "view", "other")
    rates = t("events").agg(F.array(*[F.count_if(F.col("event_type") == k) / F.count("*") for k in kinds]).alias("v"))
    return rates.select(dashboard.radar(F.col("v")).alias("v")).select(*[F.col("v")[i].alias(f"{k}_rate") for i, k in enumerate(kinds)])
