"""Text, JSON and bytes."""

from pyspark.sql import functions as F

from millrace.functions import numbers, text
from millrace.plans.registry import query
from millrace.sources import files


@query("highlight_mark", "SELECT doc_id, regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi') AS marked FROM documents")
def highlight_mark(t):
    return t("documents").select("doc_id", text.mark(F.col("text"), "the").alias("marked"))


@query(
    "strip_comments",
    r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(html, '<style>', '/*'), '</style>', '*/'), '/\*(?s:.*?)\*/', '', 'g'), '(?m)//.*?$', '', 'g'), '(?m)^static\s+', '', 'g')) AS digest FROM pages",
)
def strip_comments(t):
    code = F.replace(F.replace("html", F.lit("<style>"), F.lit("/*")), F.lit("</style>"), F.lit("*/"))
    return t("pages").select("page_id", F.md5(text.strip_static(text.strip_comments(code))).alias("digest"))


@query(
    "extract_all_calls",
    r"""
    SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '\b([a-zA-Z0-9_]+)\s*\(', 1), lambda c: c NOT IN ('if', 'while', 'for', 'switch', 'return', 'sizeof')))), ',') AS calls FROM pages
    """,
)
def extract_all_calls(t):
    return t("pages").select("page_id", F.array_join(text.calls(F.col("html")), ",").alias("calls"))


@query("composite_id_roundtrip", "SELECT page_id, concat(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '_', page_id) AS id, url AS path, page_id::INT AS line FROM pages")
def composite_id_roundtrip(t):
    rows = t("pages").select("page_id", text.encode_id(F.col("url"), F.col("page_id")).alias("id"))
    path, line = text.decode_id(F.col("id"))
    return rows.select("page_id", "id", path.alias("path"), line.alias("line"))


@query("line_number_range", "SELECT doc_id, i AS line, ls[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d, LATERAL (SELECT unnest(range(2, least(len(ls), 4) + 1)) AS i)")
def line_number_range(t):
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "content").filter(F.col("line").between(2, 4))


@query("json_nested_default", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing.deep'), 'none') AS deep FROM events")
def json_nested_default(t):
    v = F.try_parse_json("props")
    return t("events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get(v, "$.missing.deep", "string"), F.lit("none")).alias("deep"))


@query("byte_range_read", "SELECT doc_id, to_base64(encode(text)[101:164]) AS bytes, octet_length(encode(text)) AS length, octet_length(encode(text)) <= 164 AS eof FROM documents")
def byte_range_read(t):
    rows = t("documents").select("doc_id", F.encode("text", "UTF-8").alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    read = files.ranged(rows, 100, 64)
    return read.select("doc_id", text.plain_base64(F.expr("substring(content, 101, 64)")).alias("bytes"), "length", "eof")


@query("annotate_lines", "SELECT doc_id, array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN contains(x, 'Licensed') THEN [x, '// license'] ELSE [x] END)), chr(10)) AS annotated FROM documents WHERE contains(text, 'Licensed')")
def annotate_lines(t):
    return t("documents").filter(F.contains("text", F.lit("Licensed"))).select("doc_id", text.insert_after(F.col("text"), "Licensed", "// license").alias("annotated"))


@query(
    "operator_signs",
    "SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(text, ' the ', '='), ' of ', '&'), ' and ', '->'), ' in ', '.'), ' la ', '[]'), ' de ', '*'), ' der ', '(cast)')) AS digest FROM documents",
)
def operator_signs(t):
    dot = F.col("text")
    for word, name in zip((" the ", " of ", " and ", " in ", " la ", " de ", " der "), text.OPERATORS, strict=True):
        dot = F.replace(dot, F.lit(word), F.lit(name))
    return t("documents").select("doc_id", F.md5(text.operator_signs(dot)).alias("digest"))


@query("strip_fences", r"SELECT doc_id, md5(regexp_replace(concat('```c', chr(10), text, chr(10), '```'), '```\w*', '', 'g')) AS digest FROM documents")
def strip_fences(t):
    return t("documents").select("doc_id", F.md5(text.strip_fences(F.concat(F.lit("```c\n"), "text", F.lit("\n```")))).alias("digest"))


@query("human_sizes", "SELECT p_partkey, CASE WHEN p_size * 37 < 1024 THEN concat(p_size * 37, ' B') ELSE concat(printf('%.2f', p_size * 37 / 1024), ' KB') END AS shown FROM part")
def human_sizes(t):
    return t("part").select("p_partkey", numbers.human_size(F.col("p_size") * 37).alias("shown"))
