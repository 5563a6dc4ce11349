"""File kinds by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import paths

# Extension, mime type, language, binary.
KINDS = (
    (".js", "text/javascript", "javascript", False),
    (".jsx", "text/javascript", "javascript", False),
    (".ts", "text/typescript", "typescript", False),
    (".tsx", "text/typescript", "typescript", False),
    (".json", "application/json", "json", False),
    (".md", "text/markdown", "markdown", False),
    (".vue", "text/plain", "html", False),
    (".html", "text/html", "html", False),
    (".htm", "text/html", "html", False),
    (".css", "text/css", "css", False),
    (".scss", "text/x-scss", "scss", False),
    (".less", "text/x-less", "less", False),
    (".py", "text/x-python", "python", False),
    (".java", "text/x-java-source", "java", False),
    (".c", "text/x-c", "c", False),
    (".cpp", "text/x-c", "cpp", False),
    (".h", "text/x-c", "cpp", False),
    (".cs", "text/plain", "csharp", False),
    (".go", "text/plain", "go", False),
    (".rs", "text/plain", "rust", False),
    (".php", "text/x-php", "php", False),
    (".rb", "text/x-ruby", "ruby", False),
    (".sh", "text/x-sh", "shell", False),
    (".bat", "text/plain", "bat", False),
    (".xml", "text/xml", "xml", False),
    (".yml", "text/yaml", "yaml", False),
    (".yaml", "text/yaml", "yaml", False),
    (".sql", "text/plain", "sql", False),
    (".ini", "text/plain", "ini", False),
    (".conf", "text/plain", "plaintext", False),
    (".txt", "text/plain", "plaintext", False),
    (".log", "text/plain", "plaintext", False),
    (".gitignore", "text/plain", "plaintext", False),
    (".env", "text/plain", "plaintext", False),
    (".png", "image/png", "plaintext", True),
    (".jpg", "image/jpeg", "plaintext", True),
    (".jpeg", "image/jpeg", "plaintext", True),
    (".gif", "image/gif", "plaintext", True),
    (".webp", "image/webp", "plaintext", True),
    (".pdf", "application/pdf", "plaintext", True),
    (".zip", "application/zip", "plaintext", True),
    (".rar", "application/x-rar-compressed", "plaintext", True),
    (".7z", "application/x-7z-compressed", "plaintext", True),
    (".tar", "application/x-tar", "plaintext", True),
    (".gz", "application/gzip", "plaintext", True),
)
UNKNOWN = ("application/octet-stream", "plaintext", True)
# The editor's languages and the extensions that it won't open.
EDITOR = {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "html": "html", "css": "css", "json": "json", "py": "python", "md": "markdown", "vue": "html"}
BINARY = ("png", "jpg", "jpeg", "gif", "webp", "pdf", "zip", "rar", "7z")


def kind_of(path: Column) -> Column:
    """STRUCT<mime, language, binary> by the path's extension."""
    table = F.create_map(*[c for ext, mime, lang, binary in KINDS for c in (F.lit(ext), F.struct(F.lit(mime).alias("mime"), F.lit(lang).alias("language"), F.lit(binary).alias("binary")))])
    other = F.struct(F.lit(UNKNOWN[0]).alias("mime"), F.lit(UNKNOWN[1]).alias("language"), F.lit(UNKNOWN[2]).alias("binary"))
    return F.coalesce(F.try_element_at(table, paths.node_extension(path)), other)


def editor_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EDITOR.items() for x in pair])
    return F.coalesce(F.try_element_at(table, paths.extension(path)), F.lit("plaintext"))


def is_binary(path: Column) -> Column:
    return paths.extension(path).isin(*BINARY)


def preview(mime: Column) -> Column:
    """What a page can show of a binary file."""
    return F.when(mime.isNull() | (mime == ""), "none").when(F.startswith(mime, F.lit("image/")), "image").when(mime == "application/pdf", "pdf").otherwise("other")
