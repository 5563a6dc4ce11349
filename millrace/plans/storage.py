"""File trees, file contents, archives, sinks and changes of stored rows.

Files are made from the tables: as frames of (path, content, length, modified), or written below the scratch folder and read back.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import arrays, paths, text
from millrace.operators import dml, graph, listing, trees
from millrace.plans.registry import query
from millrace.session import Scratch
from millrace.sources import archives, files, results, sinks, stored

_WEB = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def _pages(t):
    """The pages as files: path, content, length, modified."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    content = F.encode("html", "UTF-8")
    return t("pages").select(path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("length"), F.lit("2024-01-01").cast("timestamp").alias("modified"))


def _texts(t):
    """The documents as files of four kinds."""
    k = F.col("doc_id") % 4
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(k == 0, ".txt").when(k == 1, ".MD").when(k == 2, ".png").otherwise(".x"))
    content = F.encode("text", "UTF-8")
    return t("documents").select("doc_id", path.alias("path"), content.alias("content"), (F.octet_length(content) * 100).cast("long").alias("length"), F.lit("2024-01-01").cast("timestamp").alias("modified"))


@query(
    "dir_listing",
    f"""
    WITH p AS (SELECT split_part({_WEB}, '/', 1) AS name, contains({_WEB}, '/') AS is_dir, octet_length(encode(html)) AS n FROM pages)
    SELECT name, CASE WHEN is_dir THEN 'dir' ELSE 'file' END AS type, name AS path, CASE WHEN NOT is_dir THEN max(n) END AS size FROM p GROUP BY name, is_dir
    """,
)
def dir_listing(t):
    return files.listing(_pages(t)).select("name", "type", "path", "size")


@query(
    "dir_listing_below",
    f"""
    WITH p AS (SELECT substr({_WEB}, length('blog.tionsh.example.net/') + 1) AS rest, octet_length(encode(html)) AS n FROM pages WHERE starts_with({_WEB}, 'blog.tionsh.example.net/'))
    SELECT split_part(rest, '/', 1) AS name, CASE WHEN contains(rest, '/') THEN 'dir' ELSE 'file' END AS type, concat('blog.tionsh.example.net/', split_part(rest, '/', 1)) AS path, CASE WHEN NOT contains(rest, '/') THEN max(n) END AS size FROM p GROUP BY split_part(rest, '/', 1), contains(rest, '/')
    """,
)
def dir_listing_below(t):
    return files.listing(_pages(t), "blog.tionsh.example.net").select("name", "type", "path", "size")


@query("file_scan", "SELECT concat('region=', n_regionkey) AS folder, string_agg(n_name, ',' ORDER BY n_name) AS names, sum(length(n_name) + 1)::BIGINT AS size FROM nation GROUP BY n_regionkey")
def file_scan(t):
    nations = t("nation")
    root = Scratch(nations.sparkSession, "file-scan").path("tree")
    nations.select(F.col("n_regionkey").alias("region"), "n_name").write.partitionBy("region").text(root)
    found = files.scan(nations.sparkSession, root).filter(F.endswith("path", F.lit(".txt")))
    lines = found.select(paths.first_segment(F.col("path")).alias("folder"), "length", F.split(text.strip(files.text_of(F.col("content"))), "\n").alias("lines"))
    return lines.groupBy("folder").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("lines"))), ",").alias("names"), F.sum("length").alias("size"))


@query("code_file_list", "SELECT path FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN concat('src/m', c_custkey, '.c') WHEN 1 THEN concat('src/M', c_custkey, '.H') WHEN 2 THEN concat('doc/d', c_custkey, '.json') WHEN 3 THEN concat('t', c_custkey, '.txt') ELSE 'x/meta.json' END AS path FROM customer) WHERE lower(path) LIKE '%.c' OR lower(path) LIKE '%.h' OR lower(path) LIKE '%.json' ORDER BY path")
def code_file_list(t):
    k, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("src/m"), key, F.lit(".c"))).when(k == 1, F.concat(F.lit("src/M"), key, F.lit(".H"))).when(k == 2, F.concat(F.lit("doc/d"), key, F.lit(".json"))).when(k == 3, F.concat(F.lit("t"), key, F.lit(".txt"))).otherwise("x/meta.json")
    return files.code_files(t("customer").select(path.alias("path")).union(t("region").select(F.lit("meta.json"))))


def _name(path):
    return F.regexp_extract(path, "[^/]+$", 0)


def _archives(t):
    """The paths of one archive for each nation, written member by member, and of broken ones."""
    customers, key = t("customer"), F.col("c_custkey").cast("string")
    spark, root = customers.sparkSession, Scratch(customers.sparkSession, "zips").path("out")
    kind = F.when(F.col("c_custkey") % 3 == 0, ".c").when(F.col("c_custkey") % 3 == 1, ".H").otherwise(".txt")
    rows = customers.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("folder"), F.concat(F.lit("p/"), key, kind).alias("path"), F.encode("c_name", "UTF-8").alias("content"))
    written = archives.write_archives(rows, root).select("path", F.col("size").alias("length"))
    broken = t("region").select(F.concat(F.lit("bad"), F.col("r_regionkey").cast("string"), F.lit(".zip")).alias("name"), F.encode("r_name", "UTF-8").alias("content"))
    return written.unionByName(sinks.write_files(broken, f"{root}-broken"))


@query("zip_roundtrip", "SELECT concat('n', c_nationkey, '.zip') AS archive, concat('p/', c_custkey, CASE c_custkey % 3 WHEN 0 THEN '.c' WHEN 1 THEN '.H' ELSE '.txt' END) AS path, c_name AS content, length(c_name)::BIGINT AS length FROM customer")
def zip_roundtrip(t):
    read = archives.contents(archives.members(_archives(t)), piece=1 << 30)
    return read.select(_name("archive").alias("archive"), "path", files.text_of(F.col("content")).alias("content"), F.octet_length("content").cast("long").alias("length"))


@query("zip_code_counts", "SELECT concat('n', c_nationkey, '.zip') AS archive, count(*) FILTER (c_custkey % 3 < 2) AS c_files, count(*) AS files FROM customer GROUP BY c_nationkey UNION ALL SELECT concat('bad', r_regionkey, '.zip'), 0, 0 FROM region")
def zip_code_counts(t):
    packed = _archives(t)
    return files.archive_summary(packed, archives.members(packed)).select(_name("archive").alias("archive"), "c_files", "files")


@query(
    "upload_limits",
    "WITH f AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) * 20000 AS length, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, length FROM f WHERE length > 1073741824 OR n > 6",
)
def upload_limits(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.floor("l_extendedprice") * 20000).alias("length"))
    return files.upload_errors(rows, "l_orderkey", max_files=6)


@query("text_reading", "SELECT doc_id, md5(concat(text, chr(65533), '!')) AS shown, md5(concat(replace(text, chr(65533), ''), '!')) AS dropped FROM documents")
def text_reading(t):
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF21")))
    return t("documents").select("doc_id", F.md5(files.text_of(broken)).alias("shown"), F.md5(files.text_dropping(broken)).alias("dropped"))


@query(
    "file_read",
    """
    WITH f AS (SELECT doc_id, doc_id % 4 AS k, text, octet_length(encode(text)) * 100 AS size FROM documents)
    SELECT doc_id, size, CASE WHEN k < 2 THEN 'text' ELSE 'binary' END AS kind, CASE WHEN k < 2 AND size > 1048576 THEN 413 ELSE 200 END AS status,
      CASE k WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'image/png' ELSE 'application/octet-stream' END AS mime, CASE k WHEN 1 THEN 'markdown' ELSE 'plaintext' END AS language,
      CASE WHEN k < 2 AND size <= 1048576 THEN md5(text) END AS content, CASE WHEN k >= 2 THEN md5(to_base64(encode(text))) END AS content_base64 FROM f
    """,
)
def file_read(t):
    found = files.read(_texts(t)).withColumn("doc_id", F.regexp_extract("path", r"d(\d+)\.", 1).cast("long"))
    return found.select("doc_id", "size", "kind", "status", "mime", "language", F.md5("content").alias("content"), F.md5("content_base64").alias("content_base64"))


def _designs(t):
    """JSON files of the customers: one function, a list of two, broken text, another object, or a description of the project."""
    k, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    one = lambda name: F.concat(F.lit('{"function_design": {"basic_info": {"function_name": "'), name, F.lit('", "function_desc": "of '), key, F.lit('"}}}'))
    shared = F.concat(F.lit(" s"), (F.col("c_custkey") % 7).cast("string"), F.lit(" "))
    raw = F.when(k == 0, one(F.concat(F.lit("f"), key))).when(k == 1, F.concat(F.lit("["), one(F.concat(F.lit("g"), key)), F.lit(", "), one(shared), F.lit("]"))).when(k == 2, F.concat(F.lit("{broken "), key)).when(k == 3, '{"other": 1}').otherwise(one(F.concat(F.lit("m"), key)))
    path = F.when(k == 4, F.concat(F.lit("p"), key, F.lit("/meta.json"))).otherwise(F.concat(F.lit("p/d"), F.lpad(key, 9, "0"), F.lit(".json")))
    return t("customer").select(path.alias("path"), F.encode(raw, "UTF-8").alias("content"))


@query(
    "design_documents",
    """
    WITH d AS (SELECT c_custkey AS k, concat('p/d', lpad(c_custkey::VARCHAR, 9, '0'), '.json') AS path FROM customer),
    n AS (SELECT concat('f', k) AS name, k, path FROM d WHERE k % 5 = 0 UNION ALL SELECT concat('g', k), k, path FROM d WHERE k % 5 = 1 UNION ALL SELECT concat('s', k % 7), k, path FROM d WHERE k % 5 = 1)
    SELECT name, max(path) AS path, concat('of ', arg_max(k, path)) AS description FROM n GROUP BY name
    """,
)
def design_documents(t):
    return files.design_documents(_designs(t)).select("name", "path", F.col("doc.basic_info.function_desc").alias("description"))


@query("design_present", "SELECT true AS present UNION ALL SELECT false")
def design_present(t):
    found = files.design_documents(_designs(t))
    return files.has_any(found).unionByName(files.has_any(found.filter("name = 'none'")))


@query(
    "item_index",
    "SELECT item, max(folder) AS folder FROM (SELECT concat('i', c_custkey % 40) AS item, concat('p', c_nationkey, '/i', c_custkey % 40) AS folder FROM customer WHERE c_custkey % 3 = 0) GROUP BY item",
)
def item_index(t):
    k = F.col("c_custkey") % 3
    item = F.concat(F.lit("p"), F.col("c_nationkey").cast("string"), F.lit("/i"), (F.col("c_custkey") % 40).cast("string"))
    path = F.when(k == 0, F.concat(item, F.lit("/a.c"))).when(k == 1, F.concat(F.lit("."), item, F.lit("/a.c"))).otherwise(item)
    return files.item_index(t("customer").select(path.alias("path")))


_IGNORED = """
    WITH f AS (SELECT c_custkey AS k, concat(CASE c_custkey % 4 WHEN 0 THEN 'build/' WHEN 1 THEN 'src/build/' WHEN 2 THEN 'log/deep/er/' ELSE '' END, CASE c_custkey % 5 WHEN 0 THEN 't' WHEN 1 THEN 'keep' ELSE 'f' END, c_custkey % 10, CASE c_custkey % 3 WHEN 0 THEN '.o' WHEN 1 THEN '.c' ELSE '.tmp' END) AS path FROM customer)
    SELECT DISTINCT path FROM f WHERE k % 4 <> 0 AND NOT (k % 3 = 0 AND k % 5 <> 1) AND NOT (k % 4 = 2 AND k % 3 = 2) AND NOT (k % 5 = 0 AND k % 3 = 1 AND k % 10 < 5)
    """
_RULES = ["# what is built", "/build/", "*.o", "!keep*.o", "log/**/*.tmp", "t[0-4].c"]


def _built(t):
    """The paths of a tree with built files and a ``.git`` folder."""
    k = F.col("c_custkey")
    folder = F.when(k % 4 == 0, "build/").when(k % 4 == 1, "src/build/").when(k % 4 == 2, "log/deep/er/").otherwise("")
    name = F.concat(F.when(k % 5 == 0, "t").when(k % 5 == 1, "keep").otherwise("f"), (k % 10).cast("string"), F.when(k % 3 == 0, ".o").when(k % 3 == 1, ".c").otherwise(".tmp"))
    git = t("region").select(F.concat(F.lit("a/.git/"), "r_name"))
    return t("customer").select(F.concat(folder, name).alias("path")).union(git)


@query("ignore_scan", _IGNORED)
def ignore_scan(t):
    return files.not_ignored(_built(t), _RULES).distinct()


@query("ignore_root_file", _IGNORED + " UNION ALL SELECT '.gitignore'")
def ignore_root_file(t):
    # The rules stand in the tree's own file, written and read with the others.
    tree = _built(t).distinct()
    rules = tree.sparkSession.createDataFrame([(".gitignore", "\n".join(_RULES))], "path string, rules string")
    rows = tree.select("path", F.lit("").alias("rules")).unionByName(rules).select("path", F.encode("rules", "UTF-8").alias("content"))
    return files.not_ignored_by_root(Scratch(tree.sparkSession, "ignored").table("tree", rows)).select("path")


@query("seed_absent", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT -1, 'seed'")
def seed_absent(t):
    rows = t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    first = rows.sparkSession.createDataFrame([(-1, "seed")], rows.schema)
    return dml.seed(rows, first).unionByName(dml.seed(rows.filter("k < 0"), first))


@query(
    "task_load",
    """
    SELECT c_custkey AS task_id, event_id IS NOT NULL AS found, props AS code, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS status, CASE WHEN event_type NOT IN ('error', 'view') THEN user_id END AS passed
    FROM customer LEFT JOIN events ON event_id = c_custkey * 8
    """,
)
def task_load(t):
    # The metadata of errors is broken, that of views missing.
    kind = F.col("event_type")
    meta = F.to_json(F.struct(kind.alias("status"), F.struct(F.col("user_id").alias("passed"), F.lit(0).alias("failed")).alias("result")))
    tasks = t("events").select(F.col("event_id").alias("task_id"), F.col("props").alias("code"), F.when(kind == "error", F.concat(F.lit("{"), meta)).when(kind != "view", meta).alias("meta"))
    wanted = t("customer").select((F.col("c_custkey") * 8).alias("task_id"))
    return files.load_tasks(tasks, wanted).select((F.col("task_id") / 8).cast("long").alias("task_id"), "found", "code", "status", F.col("result.passed").alias("passed"))


@query("nm_symbols", "SELECT concat('o', p_partkey, '.o') AS file, concat('fn', p_partkey) AS symbol FROM part UNION ALL SELECT concat('o', p_partkey, '.o'), 'local' FROM part WHERE p_partkey % 2 = 0")
def nm_symbols(t):
    key = F.col("p_partkey").cast("string")
    raw = F.concat(F.lit("fn"), key, F.lit(" T 0000 10\nputs U\n"), F.when(F.col("p_partkey") % 2 == 0, "local  t 20 4\n").otherwise("data D 8 8\n"))
    return files.symbols(t("part").select(F.concat(F.lit("o"), key, F.lit(".o")).alias("file"), raw.alias("content")))


@query(
    "child_delete",
    """
    WITH c AS (SELECT l_orderkey AS o, l_linenumber AS n, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey), g AS (SELECT o, n FROM c WHERE n = 2 AND o_custkey % 3 = 0),
    s AS (SELECT o, count(*) - count(*) FILTER (n = 2 AND o_custkey % 3 = 0) AS left_over FROM c GROUP BY o)
    SELECT o_orderkey AS id, 0 AS line, coalesce(left_over, 0) AS n FROM orders LEFT JOIN s ON s.o = o_orderkey UNION ALL SELECT o, n, 1 FROM c WHERE NOT (n = 2 AND o_custkey % 3 = 0)
    """,
)
def child_delete(t):
    # Each order's second line is asked away by its customer if that has a key that divides by three, else by another.
    counts = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(counts, "o_orderkey", "left").na.fill(0, ["n"])
    child = F.concat_ws("-", "l_orderkey", "l_linenumber")
    lines = t("lineitem").select(child.alias("child"), F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"))
    asked = lines.filter("line = 2").join(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("child", F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).otherwise(F.lit(-1)).alias("by"))
    parents, left = dml.delete_owned(orders, lines, asked, "o_orderkey", "child", "o_custkey", "by", "n")
    return parents.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("line"), "n").union(left.select("o_orderkey", "line", F.lit(1).cast("long")))


@query("batch_delete", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def batch_delete(t):
    return dml.delete(t("part").select("p_partkey", "p_name"), t("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey")


@query("json_lines", "SELECT event_id, user_id, event_type FROM events")
def json_lines(t):
    # Written as JSON lines and read back.
    rows = t("events").select("event_id", "user_id", "event_type")
    at = Scratch(rows.sparkSession, "json-lines").path("out")
    sinks.write_json_lines(rows, at)
    return rows.sparkSession.read.schema(rows.schema).json(at)


@query("append_results", "SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def append_results(t):
    # Results arrive in two batches; the latest of a key is taken from all that was appended.
    rows = t("events").select("user_id", "event_id", "event_type")
    at = Scratch(rows.sparkSession, "append-results").path("results")
    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")):
        sinks.append(part, at)
    kept = rows.sparkSession.read.schema(rows.schema).parquet(at)
    return kept.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("event_id"), F.count("*").alias("n"))


@query(
    "upsert_newest",
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'D' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS at FROM orders UNION ALL SELECT -1 - n_nationkey, 'new', TIMESTAMP '2030-01-01' FROM nation",
)
def upsert_newest(t):
    tasks = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))
    done = tasks.filter("status = 'P'").select("id", F.lit("D").alias("status"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("at"))
    new = t("nation").select((-1 - F.col("n_nationkey")).cast("long").alias("id"), F.lit("new").alias("status"), F.lit("2030-01-01").cast(tasks.schema["at"].dataType).alias("at"))
    return dml.upsert(tasks, done.unionByName(new), "id", "at")


@query("text_sink", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1")
def text_sink(t):
    at = Scratch(t("part").sparkSession, "text-sink").path("out")
    sinks.write_text(t("part"), "p_name", at)
    return t("part").sparkSession.read.text(at).groupBy("value").agg(F.count("*").alias("n"))


@query(
    "dot_text",
    "SELECT concat('digraph callgraph {', chr(10), string_agg(concat('  \"', r_name, '\" -> \"', n_name, '\";'), chr(10) ORDER BY concat('  \"', r_name, '\" -> \"', n_name, '\";')), chr(10), '}') AS dot FROM nation JOIN region ON r_regionkey = n_regionkey",
)
def dot_text(t):
    edges = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return graph.dot(edges)


@query("without_artifacts", "SELECT concat('t/', c_custkey, CASE c_custkey % 6 WHEN 4 THEN '.c' ELSE '.log' END) AS path FROM customer WHERE c_custkey % 6 > 3")
def without_artifacts(t):
    k = F.col("c_custkey") % 6
    end = F.when(k == 0, ".o").when(k == 1, ".gcda").when(k == 2, ".gcno").when(k == 3, ".info").when(k == 4, ".c").otherwise(".log")
    return dml.without_artifacts(t("customer").select(F.concat(F.lit("t/"), F.col("c_custkey").cast("string"), end).alias("path")))


@query("map_put_get", "SELECT user_id, -1.0::DOUBLE AS purchase, max(value) FILTER (event_type = 'view') AS viewed, (count(DISTINCT event_type) + CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 1 ELSE 0 END)::INT AS entries FROM events GROUP BY user_id")
def map_put_get(t):
    best = t("events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    maps = best.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("m"))
    put = maps.withColumn("m", arrays.put(F.col("m"), F.lit("purchase"), F.lit(-1.0)))
    return put.select("user_id", F.try_element_at("m", F.lit("purchase")).alias("purchase"), F.try_element_at("m", F.lit("view")).alias("viewed"), F.size("m").alias("entries"))


@query("compact_map", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'a')), lambda w: upper(w)), ',') AS words FROM part")
def compact_map(t):
    words = arrays.compact_map(F.split("p_name", " "), lambda w: F.when(F.contains(w, F.lit("a")), F.upper(w)))
    return t("part").select("p_partkey", F.array_join(words, ",").alias("words"))


@query("path_guard", "SELECT page_id, page_id % 6 < 3 AS inside FROM pages")
def path_guard(t):
    k, tail = F.col("page_id") % 6, F.regexp_extract("url", r"//([^/?#]+)", 1)
    path = F.when(k == 0, F.concat(F.lit("base/"), tail)).when(k == 1, F.concat(F.lit("base/./a/../"), tail)).when(k == 2, "base/x/..").when(k == 3, F.concat(F.lit("base/../"), tail)).when(k == 4, F.concat(F.lit("basement/"), tail)).otherwise(F.concat(F.lit("base/a/../../../base/"), tail))
    return t("pages").select("page_id", paths.inside(F.lit("base"), path).alias("inside"))


@query("path_suffix", f"SELECT page_id FROM pages WHERE {_WEB} = 'en/98' OR {_WEB} LIKE '%/en/98'")
def path_suffix(t):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return t("pages").filter(paths.same_or_below_any(path, F.lit("en/98"))).select("page_id")


_TREE = """
    WITH f AS (SELECT DISTINCT concat('d', c_nationkey, '/s', c_custkey % 4, '/f', c_custkey % 9, '.c') AS path FROM customer),
    n AS (SELECT path, true AS is_file FROM f UNION ALL SELECT DISTINCT regexp_replace(path, '/[^/]*$', ''), false FROM f UNION ALL SELECT DISTINCT split_part(path, '/', 1), false FROM f)
"""


def _tree(t):
    k = F.col("c_custkey")
    path = F.concat(F.lit("d"), F.col("c_nationkey").cast("string"), F.lit("/s"), (k % 4).cast("string"), F.lit("/f"), (k % 9).cast("string"), F.lit(".c"))
    return trees.nodes(t("customer").select(path.alias("path")).distinct())


@query(
    "subtree_refresh",
    _TREE + "SELECT path, is_file FROM n WHERE NOT starts_with(path, 'd3/') OR starts_with(path, 'd3/s1/') UNION ALL SELECT 'd3/s1', false UNION ALL SELECT 'd3/new.c', true",
)
def subtree_refresh(t):
    # The fresh listing of d3 has one old directory and a new file.
    tree = _tree(t)
    fresh = tree.sparkSession.createDataFrame([("d3/s1", "d3", "s1", 2, False), ("d3/new.c", "d3", "new.c", 2, True)], tree.schema)
    return trees.refresh(tree, "d3", fresh).select("path", "is_file")


@query(
    "tree_changes",
    _TREE + "SELECT path, is_file FROM n WHERE path <> 'd3' AND NOT starts_with(path, 'd3/') UNION ALL SELECT 'd9/fresh.c', true",
)
def tree_changes(t):
    # A directory goes with all below it, a file comes, and what is there already stays as it is.
    tree = dml.remove(dml.remove(_tree(t).select("path", "is_file"), "d3"), "nowhere")
    return dml.create(dml.create(tree, "d9/fresh.c", True), "d1", True)


@query("tree_sorted", _TREE + "SELECT path, is_file FROM n")
def tree_sorted(t):
    return trees.tree_order(_tree(t)).select("path", "is_file")


@query("readme_at_root", "SELECT DISTINCT CASE n_nationkey % 2 WHEN 0 THEN 'README.md' ELSE 'readme.MD' END AS path FROM nation WHERE n_nationkey % 3 = 2")
def readme_at_root(t):
    k = F.col("n_nationkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("d"), k.cast("string"), F.lit("/README.md"))).when(k % 3 == 1, F.concat(F.lit("x"), k.cast("string"), F.lit(".c"))).otherwise(F.when(k % 2 == 0, "README.md").otherwise("readme.MD"))
    return trees.readme(trees.nodes(t("nation").select(path.alias("path")).distinct())).select("path")


@query("source_ranked", "SELECT c_custkey AS id, 0 AS source_rank FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier")
def source_ranked(t):
    return listing.ranked([(t("customer").select(F.col("c_custkey").alias("id")), "id", True), (t("supplier").select(F.col("s_suppkey").alias("id")), "id", False)])


@query("archive_names", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('a.b', c_custkey) WHEN 1 THEN '.hidden' ELSE concat('plain', c_custkey) END AS base, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN '' ELSE concat('plain', c_custkey) END AS before_dot FROM customer")
def archive_names(t):
    k, key = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("a.b"), key, F.lit(".zip"))).when(k == 1, ".hidden").otherwise(F.concat(F.lit("plain"), key))
    return t("customer").select("c_custkey", paths.archive_name(name).alias("base"), paths.first_dot_name(name).alias("before_dot"))


@query("path_join", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('a/b/', c_name) WHEN 1 THEN concat('r/', c_name) ELSE c_name END AS path, CASE c_custkey % 3 WHEN 0 THEN 'a/b' WHEN 1 THEN 'r' ELSE '' END AS parent FROM customer")
def path_join(t):
    k = F.col("c_custkey") % 3
    path = paths.join_path(F.when(k == 0, "/a/b").when(k == 1, "//r").otherwise(""), F.col("c_name"))
    return t("customer").select("c_custkey", path.alias("path"), paths.dirname(path).alias("parent"))


@query("archive_members", "SELECT concat(coalesce(source, 'none'), '.zip') AS archive, concat('t/', doc_id, '.txt') AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS length, md5(coalesce(text, '')) AS content, true AS intact FROM documents WHERE doc_id IS NOT NULL")
def archive_members(t):
    # The texts of each source become one archive, written and read member by member.
    path = F.concat(F.lit("t/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = t("documents").select(F.coalesce("source", F.lit("none")).alias("folder"), path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    spark = rows.sparkSession
    written = archives.write_archives(rows, Scratch(spark, "archive-members").path("out"))
    read = archives.contents(archives.members(written.select("path")), piece=1 << 30)
    return read.select(F.regexp_extract("archive", "[^/]+$", 0).alias("archive"), "path", F.octet_length("content").cast("long").alias("length"), F.md5("content").alias("content"), "intact")


@query("range_chunks", "SELECT count(*) AS lines, sum(octet_length(encode(p_name)) + 1)::BIGINT AS bytes, sum(length(p_name) - length(replace(p_name, 'a', '')))::BIGINT AS letters, true AS ended FROM part")
def range_chunks(t):
    # Text files in ranges of a thousand bytes.
    spark = t("part").sparkSession
    at = Scratch(spark, "range-chunks").path("out")
    sinks.write_text(t("part"), "p_name", at)
    chunks = archives.byte_ranges(spark, at, chunk=1000)
    count = lambda what: F.sum(F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(what))).alias
    ends = F.count_if("eof") == F.count_distinct("path")
    return chunks.agg(count("\n")("lines"), F.sum("limit").alias("bytes"), count("a")("letters"), ends.alias("ended"))


@query(
    "stored_changes",
    """
    SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'PATCHED' WHEN c_custkey % 10 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0
    UNION ALL SELECT c_custkey, 'NEW', 0.0 FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT -1 - n_nationkey, n_name, 1.0 FROM nation
    """,
)
def stored_changes(t):
    # The table is changed where it is stored: rows are patched, deleted, replaced and appended.
    rows = t("customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    at = Scratch(rows.sparkSession, "stored-changes").path("customer")
    table = stored.Stored.create(rows, at, "c_custkey", 16)
    k = F.col("c_custkey") % 10
    table.patch(rows.filter(k < 2).select("c_custkey", F.when(k == 0, "PATCHED").alias("c_mktsegment"), F.array(F.lit("c_mktsegment")).alias("named")), fields_set="named")
    table.delete(rows.filter("c_custkey % 7 = 0"))
    table.upsert(rows.filter("c_custkey % 11 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal")))
    table.insert(t("nation").select((-1 - F.col("n_nationkey")).alias("c_custkey"), F.col("n_name").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal")))
    return table.read()


@query(
    "stored_cascade",
    "SELECT 'order' AS kind, o_orderkey AS id, 0 AS line FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT 'item', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)",
)
def stored_cascade(t):
    # As cascade_delete, with both tables changed in their buckets.
    orders, items = t("orders").select("o_orderkey", "o_custkey"), t("lineitem").select("l_orderkey", "l_linenumber")
    at = Scratch(orders.sparkSession, "stored-cascade").path
    parents, children = stored.Stored.create(orders, at("orders"), "o_orderkey", 16), stored.Stored.create(items, at("items"), "l_orderkey", 16)
    stored.cascade(parents, children, orders.filter("o_custkey % 7 = 0"))
    first = parents.read().select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(0).alias("line"))
    return first.union(children.read().select(F.lit("item"), "l_orderkey", "l_linenumber"))


_NAMES = ("Äpfel", "apfel", "Zebra", "zebra", "école", "Ecole", "ecole", "中文", "一", "_x", "10", "9", "ñandú", "nandu", "straße", "Strasse")


@query(
    "locale_order",
    f"""
    WITH f AS (SELECT DISTINCT concat('d', c_nationkey) AS parent, concat([{", ".join(f"'{n}'" for n in _NAMES)}][c_custkey % {len(_NAMES)} + 1], CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.c' END) AS name, c_custkey % 3 <> 0 AS is_file FROM customer)
    SELECT concat(parent, '/', name) AS path, is_file, row_number() OVER (PARTITION BY parent ORDER BY is_file, icu_sort_key(name, 'en'), name) AS position FROM f
    """,
)
def locale_order(t):
    # Names with accents, capitals and ideographs in the order of the root locale, directories first.
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (k % len(_NAMES) + 1).cast("int"))
    path = F.concat(F.lit("d"), F.col("c_nationkey").cast("string"), F.lit("/"), name, F.when(k % 3 == 0, "/f.c").otherwise(".c"))
    tree = trees.nodes(t("customer").select(path.alias("path")).distinct()).filter("depth = 2")
    inside = Window.partitionBy("parent").orderBy("is_file", *trees.name_order("name", "UNICODE"))
    return tree.select("path", "is_file", F.row_number().over(inside).cast("long").alias("position"))


@query("reused_counts", "SELECT source, count(*) AS documents, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes, true AS reused FROM documents GROUP BY source")
def reused_counts(t):
    # The same counts asked for twice: the second time they are read from the copy that the first one stored.
    def counts():
        return t("documents").groupBy("source").agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length(F.encode("text", "UTF-8"))), F.lit(0)).cast("long").alias("bytes"))

    root = Scratch(counts().sparkSession, "reused-counts").root
    first, second = results.reused(counts(), "counts", root), results.reused(counts(), "counts", root)
    return second.withColumn("reused", F.lit(first.inputFiles() == second.inputFiles()))
