"""File trees, file contents, archives and JSON documents.

Everything starts from Spark's ``binaryFile`` rows (path, modificationTime, length, content), so any store Spark reads will do. There
are no rows for empty directories; listings don't show them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import media, paths, text

INLINE_LIMIT, CHUNK = 1 << 20, 262_144
MAX_FILE, MAX_FILES = 1 << 30, 1000


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path (relative to the root), content, length, modified."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), F.lit("^" + "\\Q" + base + "\\E/"), F.lit(""))
    return rows.select(relative.alias("path"), "content", "length", F.col("modificationTime").alias("modified"))


def listing(files: DataFrame, parent: str = "") -> DataFrame:
    """One level below ``parent``: name, type, path, size (files only), modified; directories first, then by name."""
    prefix = f"{parent}/" if parent else ""
    below = files.filter(F.startswith("path", F.lit(prefix))).withColumn("rest", F.expr(f"substr(path, {len(prefix) + 1})"))
    name, is_dir = paths.first_segment(F.col("rest")), F.contains("rest", F.lit("/"))
    rows = below.groupBy(name.alias("name"), is_dir.alias("is_dir")).agg(F.max("length").alias("length"), F.max("modified").alias("modified"))
    out = rows.select("name", F.when(F.col("is_dir"), "dir").otherwise("file").alias("type"), F.concat(F.lit(prefix), "name").alias("path"), F.when(~F.col("is_dir"), F.col("length")).alias("size"), "modified")
    return out.orderBy("type", F.lower("name"), "name")


def code_files(files: DataFrame) -> DataFrame:
    """C sources, headers and JSON files in path order, without the root's ``meta.json``."""
    lower = F.lower("path")
    wanted = F.endswith(lower, F.lit(".c")) | F.endswith(lower, F.lit(".h")) | F.endswith(lower, F.lit(".json"))
    return files.filter(wanted & (F.col("path") != "meta.json")).orderBy("path")


def ignore_rules(patterns: list[str]) -> list[tuple[str, bool, bool]]:
    """(regular expression for a whole path, whether it takes back, whether for directories only) of each ignore pattern.

    ``*`` and ``?`` stay within a name, ``**`` crosses names, ``[..]`` is a class, ``!`` takes back, a slash before the end ties
    the pattern to the root, one at the end asks for a directory.
    """
    out = []
    for p in patterns:
        p = p.rstrip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!").removeprefix("\\")
        only_dirs, p = p.endswith("/"), p.rstrip("/")
        tied, p = "/" in p, p.removeprefix("/")
        body, k = "" if tied or p.startswith("**") else "(?:.*/)?", 0
        while k < len(p):
            if p.startswith("**/", k):
                body, k = body + "(?:.*/)?", k + 3
            elif p.startswith("**", k):
                body, k = body + ".*", k + 2
            elif p[k] == "[" and "]" in p[k + 2 :]:
                end = p.index("]", k + 2)
                inner = p[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                body, k = body + "(?!/)[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
            else:
                body, k = body + {"*": "[^/]*", "?": "[^/]"}.get(p[k], re.escape(p[k])), k + 1
        out.append((f"^{body}$", back, only_dirs))
    return out


def not_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Without ``.git`` and what the ignore patterns cover: the last that matches decides, and below an ignored directory all goes."""
    rules = [*ignore_rules(patterns), (r"^(?:.*/)?\.git$", False, False)]
    parts = paths.prefixes(F.col("path"))

    def covered(prefix: Column, place: Column) -> Column:
        is_dir, out = place < F.size(parts) - 1, F.lit(False)
        for body, back, only_dirs in rules:
            hit = F.rlike(prefix, F.lit(body)) & (is_dir if only_dirs else F.lit(True))
            out = F.when(hit, F.lit(not back)).otherwise(out)
        return out

    return files.filter(~F.exists(F.transform(parts, covered), lambda hit: hit))


def not_ignored_by_root(files: DataFrame) -> DataFrame:
    """Without ``.git`` and what the tree's own ``.gitignore`` at the root covers; ``files`` has path and content, and without that file only ``.git`` goes.

    One file of rules is read by the driver, of INLINE_LIMIT bytes at most; ignore files further down don't count.
    """
    found = files.filter(F.col("path") == ".gitignore").select(text_of(F.col("content")).alias("rules"), F.octet_length("content").alias("size")).limit(1).collect()
    if found and (found[0]["size"] or 0) > INLINE_LIMIT:
        raise ValueError(f"the tree's .gitignore has more than {INLINE_LIMIT} bytes")
    return not_ignored(files, (found[0]["rules"] or "").splitlines() if found else [])


def root_rules(spark: SparkSession, root: str) -> list[str]:
    """The lines of a folder's ``.gitignore``, in any store that Spark reads; none without it. Spark's own listings leave out hidden files."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    if store.getFileStatus(path).getLen() > INLINE_LIMIT:
        raise ValueError(f"{path} has more than {INLINE_LIMIT} bytes")
    stream = store.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def scan_not_ignored(spark: SparkSession, root: str) -> DataFrame:
    """``scan`` of a folder without what its own ``.gitignore`` covers."""
    return not_ignored(scan(spark, root), root_rules(spark, root))


def text_of(content: Column) -> Column:
    """UTF-8 with U+FFFD for what isn't."""
    return F.make_valid_utf8(content.cast("string"))


def text_dropping(content: Column) -> Column:
    """UTF-8 without what isn't; a genuine U+FFFD goes too."""
    return F.replace(text_of(content), F.lit("\ufffd"), F.lit(""))


def ranged(rows: DataFrame, offset: int, limit: int = CHUNK) -> DataFrame:
    """A byte range of each file: offset, limit (bytes given), eof and the text, cut characters replaced."""
    chunk = F.greatest(F.least(F.lit(limit).cast("long"), F.col("length") - offset), F.lit(0).cast("long"))
    out = rows.withColumns({"offset": F.lit(offset).cast("long"), "limit": chunk})
    return out.withColumns({"eof": F.col("offset") + F.col("limit") >= F.col("length"), "text": text_of(F.expr(f"substring(content, {offset + 1}, CAST(`limit` AS INT))"))})


def read(rows: DataFrame, allow_large: bool = False) -> DataFrame:
    """Each file as text, base64 or 413: kind, status, mime, language, content or content_base64."""
    kind = media.kind_of(F.col("path"))
    large = ~kind["binary"] & (F.col("length") > INLINE_LIMIT) & F.lit(not allow_large)
    return rows.select(
        "path",
        F.col("length").alias("size"),
        "modified",
        F.when(kind["binary"], "binary").otherwise("text").alias("kind"),
        F.when(large, 413).otherwise(200).alias("status"),
        kind["mime"].alias("mime"),
        kind["language"].alias("language"),
        F.when(~kind["binary"] & ~large, text_of(F.col("content"))).alias("content"),
        F.when(kind["binary"], text.plain_base64(F.col("content"))).alias("content_base64"),
    )


def zip_entries(archives: DataFrame) -> DataFrame:
    """The files inside each archive: archive, path, content, length. Broken archives have none, nor do paths that lead out.

    An archive, as stored, and each of its files must fit a task's memory; the files leave one by one.
    """

    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, content in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("/") and ".." not in i.filename.split("/")]
                        for i in names:
                            yield pd.DataFrame([(archive, i.filename, z.read(i), i.file_size)], columns=["archive", "path", "content", "length"])
                except zipfile.BadZipFile:
                    continue

    return archives.select("path", "content").mapInPandas(entries, "archive string, path string, content binary, length long")


def archive_summary(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """Each archive's size as stored, and how many C sources and headers it holds."""
    lower = F.lower("path")
    counts = entries.groupBy("archive").agg(F.count_if(F.endswith(lower, F.lit(".c")) | F.endswith(lower, F.lit(".h"))).alias("c_files"), F.count("*").alias("files"))
    return archives.select(F.col("path").alias("archive"), F.col("length").alias("size")).join(counts, "archive", "left").na.fill(0, ["c_files", "files"])


def upload_errors(files: DataFrame, upload: str | None = None, max_file: int = MAX_FILE, max_files: int = MAX_FILES) -> DataFrame:
    """Files over the size limit, and all files of an upload with too many; ``upload`` names an upload's column, None: one upload."""
    keys = [upload] if upload else []
    many = files.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_files)
    marked = files.join(many, keys, "left") if keys else files.join(F.broadcast(many), how="left")
    return marked.filter((F.col("length") > max_file) | F.col("_n").isNotNull()).drop("_n")


DESIGN = (
    "basic_info struct<function_name string, software_unit_identifier string, function_desc string>, "
    "io_params struct<input_params array<struct<param_name string, param_desc string>>, return_value array<struct<value string, desc string>>>, "
    "algorithm struct<desc string>, logic_flow struct<flow_steps array<string>>, call_relation struct<called_functions array<string>>"
)


def design_documents(files: DataFrame) -> DataFrame:
    """(name, path, doc) of each function's design: objects with ``function_design`` or lists of them; of equal names the last.

    ``meta.json`` and broken files are skipped.
    """
    json = files.filter(F.endswith("path", F.lit(".json")) & (F.col("path") != "meta.json") & ~F.endswith("path", F.lit("/meta.json")))
    parsed = json.select("path", text_of(F.col("content")).alias("raw")).withColumn("v", F.try_parse_json("raw")).filter(F.col("v").isNotNull())
    one = F.from_json("raw", f"function_design struct<{DESIGN}>")
    many = F.from_json("raw", f"array<struct<function_design struct<{DESIGN}>>>")
    items = parsed.withColumn("items", F.when(F.startswith(text.strip(F.col("raw")), F.lit("[")), many).otherwise(F.array(one)))
    rows = items.select("path", F.posexplode("items").alias("place", "item")).select("path", "place", F.col("item.function_design").alias("doc"))
    named = rows.withColumn("name", text.strip(F.col("doc.basic_info.function_name"))).filter("name <> ''")
    return named.groupBy("name").agg(F.max_by(F.struct("path", "doc"), F.struct("path", "place")).alias("last")).select("name", "last.*")


def has_any(rows: DataFrame) -> DataFrame:
    """One row: whether there is any row."""
    return rows.limit(1).agg((F.count("*") > 0).alias("present"))


def item_index(files: DataFrame) -> DataFrame:
    """The second-level directories (item, folder); hidden ones don't count; of equal names the last path."""
    item, folder = F.regexp_extract("path", "^([^/]+)/([^/]+)/", 2), F.regexp_extract("path", "^([^/]+/[^/]+)/", 1)
    rows = files.select(item.alias("item"), folder.alias("folder")).filter((F.col("item") != "") & ~F.rlike("folder", F.lit(r"(^|/)[._]")))
    return rows.groupBy("item").agg(F.max("folder").alias("folder"))


def json_or(value: Column, schema: str, default: str) -> Column:
    """The parsed value; a default for null and broken JSON."""
    return F.coalesce(F.when(F.try_parse_json(value).isNotNull(), F.from_json(value, schema)), F.from_json(F.lit(default), schema))


TASK = "status string, result struct<passed long, failed long, line_coverage double>"


def load_tasks(tasks: DataFrame, wanted: DataFrame, key: str = "task_id", code: str = "code", meta: str = "meta") -> DataFrame:
    """Each wanted task with its code, status and result from its metadata text: found, code, status, result.

    A task that isn't there isn't found; one whose metadata is missing or broken has no status and no result.
    """
    parsed = tasks.select(key, F.col(code).alias("code"), json_or(F.col(meta), TASK, "{}").alias("_meta"), F.lit(True).alias("_there"))
    out = wanted.select(key).join(parsed, key, "left")
    return out.select(key, F.coalesce("_there", F.lit(False)).alias("found"), "code", F.col("_meta.status").alias("status"), F.col("_meta.result").alias("result"))


def symbols(raw: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """Names of the text symbols in portable ``nm`` output."""
    rows = raw.select(file, F.explode(F.split(content, "\n")).alias("line")).withColumn("parts", F.split(text.strip(F.col("line")), r"\s+"))
    return rows.filter(F.get("parts", F.lit(1)).isin("T", "t")).select(file, F.get("parts", F.lit(0)).alias("symbol"))


def references(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Generated-test records from JSON text; the references, arrays of mixed types, as structs."""
    v = records.select(F.explode(F.from_json(raw, "array<string>")).alias("one")) if raw not in records.columns else records.select(F.parse_json(raw).alias("v"))
    get = lambda p, t: F.try_variant_get("v", f"$.{p}", t)
    refs = F.transform(F.try_variant_get("v", "$.rag_references", "array<variant>"), lambda r: F.struct(F.try_variant_get(r, "$[0]", "double").alias("score"), F.try_variant_get(r, "$[1]", "string").alias("ref_code"), F.try_variant_get(r, "$[2]", "string").alias("ref_test")))
    return v.select(get("project_name", "string").alias("project_name"), get("target_coverage_idx", "int").alias("target_coverage_idx"), get("running_result", "string").alias("running_result"), get("focal_method_name", "string").alias("focal_method_name"), refs.alias("rag_references"))
