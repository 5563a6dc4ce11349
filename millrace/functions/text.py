"""Text expressions: search, markup, C source patterns, ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.arrays import let

# Words that look like calls, words that are never function names, and names of graph operators.
CALL_STOP = ("if", "while", "for", "switch", "return", "sizeof")
NAME_STOP = (
    "if", "for", "while", "switch", "return", "sizeof", "typedef", "struct", "enum", "union", "else", "do", "goto", "case", "default", "break", "continue",
    "void", "int", "char", "float", "double", "unsigned", "signed", "long", "short", "static", "extern", "const", "volatile", "inline", "register", "auto",
)
OPERATORS = {
    "<operator>.assignment": "=",
    "<operator>.addressOf": "&",
    "<operator>.indirectMemberAccess": "->",
    "<operator>.fieldAccess": ".",
    "<operator>.computedMemberAccess": "[]",
    "<operator>.indirection": "*",
    "<operator>.cast": "(cast)",
}
# Headers and the names that ask for them.
HEADERS = {
    "<stdarg.h>": ("va_list", "va_start", "va_end", "va_arg"),
    "<string.h>": ("memcpy", "memset", "memmove", "strcmp", "strncmp", "strlen", "strcpy", "strncpy", "strstr", "strchr"),
    "<stdlib.h>": ("malloc", "calloc", "realloc", "free", "atoi", "atof", "atol", "exit", "abort"),
    "<stddef.h>": ("ptrdiff_t",),
}
# What a function at the start of a line looks like, and the headings of a design document.
TOP_LEVEL = (
    r"(?m)^(?:(?:static|inline|extern|const|volatile|unsigned|signed|long|short)\s+)*"
    r"(?:struct\s+\w+\s*\*?\s*|enum\s+\w+\s*|union\s+\w+\s*|\w+\s*\*?\s*)([a-zA-Z_]\w*)\s*\("
)
HEADINGS = {
    "title": "### Function Design Document (from project specification):",
    "name": "- Function Name: ",
    "identifier": "- Identifier: ",
    "description": "- Description: ",
    "inputs": "- Input Parameters:",
    "returns": "- Return Values:",
    "algorithm": "- Algorithm: ",
    "steps": "- Logic Flow Steps:",
    "calls": "- Called Functions: ",
}
# Calls, returned values, arguments, local declarations, branches, comments and static in C code.
CALL = r"\b([a-zA-Z0-9_]+)\s*\("
RETURN = r"\breturn\s+(.*?);"
ARGUMENTS = r"\(([^)]*)\)"
LOCAL = r"\b(?:int|char|float|double|long|short|void|bool)\s+[\*]*([a-zA-Z0-9_]+)\s*[;,=]"
BRANCH = r"\b(if|else\s+if|else|for|while|do|switch|case|&&|\|\||break|continue|return)\b"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"(?m)//.*?$"
STATIC = r"^\s*static\b"
LEADING_STATIC = r"(?m)^static\s+(?!inline)"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def parse_int_or(text: Column, default: int) -> Column:
    """The leading integer of a text; the default for none and for zero."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)), F.lit(default))


def contains_ci(text: Column, what: str) -> Column:
    return F.contains(F.lower(text), F.lit(what.lower()))


def mark(text: Column, what: str) -> Column:
    """The text with each occurrence of ``what``, in any case, in a mark element."""
    return F.regexp_replace(text, f"(?i)({re.escape(what)})", "<mark>$1</mark>")


def strip_comments(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(code, BLOCK_COMMENT, ""), LINE_COMMENT, "")


def is_static(signature: Column) -> Column:
    return F.rlike(F.coalesce(signature, F.lit("")), F.lit(STATIC))


def strip_static(code: Column) -> Column:
    """Without a leading ``static`` on any line, unless ``inline`` follows."""
    return F.regexp_replace(code, LEADING_STATIC, "")


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"```\w*", "")


def fenced(text: Column) -> Column:
    """The body of the first fenced block, or the text."""
    return F.when(F.rlike(text, F.lit(r"(?s)```.*?```")), strip(F.regexp_extract(text, r"(?s)```\w*\n?(.*?)```", 1))).otherwise(text)


def calls(code: Column) -> Column:
    found = F.regexp_extract_all(code, F.lit(CALL), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda c: ~c.isin(*CALL_STOP))))


def returns(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(RETURN), 1)


def variables(code: Column) -> Column:
    """Names of arguments in the first line's parentheses and of simple local declarations."""
    inside = F.regexp_extract(F.substring_index(code, "\n", 1), ARGUMENTS, 1)
    arguments = F.filter(F.transform(F.split(inside, ","), lambda a: F.split(strip(a), r"\s+")), lambda p: F.size(p) >= 2)
    names = F.transform(arguments, lambda p: F.replace(F.element_at(p, -1), F.lit("*"), F.lit("")))
    local = F.regexp_extract_all(code, F.lit(LOCAL), 1)
    return F.array_sort(F.array_distinct(F.concat(names, local)))


def code_graph(code: Column) -> Column:
    return F.struct(variables(code).alias("variables"), calls(code).alias("calls"), returns(code).alias("returns"), F.array().cast("array<string>").alias("branches"))


def top_level_names(code: Column) -> Column:
    """Names of functions at the start of a line, in order of first sight."""
    return F.array_distinct(F.filter(F.regexp_extract_all(code, F.lit(TOP_LEVEL), 1), lambda n: ~n.isin(*NAME_STOP)))


def missing_headers(code: Column) -> Column:
    """The headers whose names the code uses and that it doesn't include. The code is worked out once, however it is made."""

    def wanted(c: Column, header: str, names: tuple[str, ...]) -> Column:
        there = F.contains(c, F.lit(f"#include {header}")) | F.contains(c, F.lit(f'#include "{header[1:-1]}"'))
        return F.when(~there & F.rlike(c, F.lit(rf"\b({'|'.join(names)})\b")), F.lit(header))

    return let(code, lambda c: F.array_compact(F.array(*[wanted(c, h, n) for h, n in HEADERS.items()])))


def last_line_with(lines: Column, start: str) -> Column:
    """The 0-based place of the last line that starts so, or -1."""
    marks = F.transform(lines, lambda line, i: F.when(F.startswith(strip(line), F.lit(start)), i).otherwise(F.lit(-1)))
    return F.coalesce(F.array_max(marks), F.lit(-1))


def add_headers(code: Column) -> Column:
    """The code with its missing headers after the last include, or first."""
    lines = F.split(code, "\n")
    at = last_line_with(lines, "#include") + 1
    added = F.transform(missing_headers(code), lambda h: F.concat(F.lit("#include "), h))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), at), added, F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))), "\n")


def insert_after(text: Column, token: str, line: str) -> Column:
    """The text with a line after each line that holds the token."""
    return F.array_join(F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(F.contains(x, F.lit(token)), F.array(x, F.lit(line))).otherwise(F.array(x)))), "\n")


def plain_base64(data: Column) -> Column:
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def encode_id(path: Column, line: Column) -> Column:
    """URL-safe base64 of the path, an underscore, the line."""
    return F.concat(F.translate(plain_base64(F.encode(path, "UTF-8")), "+/", "-_"), F.lit("_"), line.cast("string"))


def decode_id(value: Column) -> tuple[Column, Column]:
    coded = F.regexp_extract(value, "^(.*)_([0-9]+)$", 1)
    return F.decode(F.unbase64(F.translate(coded, "-_", "+/")), "UTF-8"), F.regexp_extract(value, "^(.*)_([0-9]+)$", 2).try_cast("int")


def path_key(path: Column, name: Column) -> Column:
    return F.md5(F.concat_ws("::", path, name))


def operator_signs(dot: Column) -> Column:
    for name, sign in OPERATORS.items():
        dot = F.replace(dot, F.lit(name), F.lit(sign))
    return dot


def branch_tokens(code: Column) -> Column:
    return F.regexp_count(code, F.lit(BRANCH))


def complexity(code: Column) -> Column:
    """LOW up to 2 branch tokens, MED up to 6, else HIGH."""
    n = branch_tokens(code)
    return F.when(n <= 2, "LOW").when(n <= 6, "MED").otherwise("HIGH")


def token_budget(level: Column) -> Column:
    return F.when(level == "LOW", 500).when(level == "MED", 900).otherwise(1500)


def design_text(doc: Column) -> Column:
    """A design document (STRUCT with the known fields) as lines of text; missing parts leave no line."""
    items = lambda rows, one: F.array_join(F.transform(rows, one), "\n")
    basic, io = doc["basic_info"], doc["io_params"]
    some = lambda rows, head, one: F.when(F.size(rows) > 0, F.concat(F.lit(f"{head}\n"), items(rows, one)))
    head = {k: F.lit(v) for k, v in HEADINGS.items()}
    called = doc["call_relation"]["called_functions"]
    return F.concat_ws(
        "\n",
        head["title"],
        *[F.when(basic.isNotNull(), F.concat(head[k], F.coalesce(basic[f], F.lit("")))) for k, f in (("name", "function_name"), ("identifier", "software_unit_identifier"), ("description", "function_desc"))],
        some(io["input_params"], HEADINGS["inputs"], lambda p: F.concat(F.lit("    - "), p["param_name"], F.lit(": "), p["param_desc"])),
        some(io["return_value"], HEADINGS["returns"], lambda r: F.concat(F.lit("    - "), r["value"], F.lit(": "), r["desc"])),
        F.when(doc["algorithm"]["desc"] != "", F.concat(head["algorithm"], doc["algorithm"]["desc"])),
        some(doc["logic_flow"]["flow_steps"], HEADINGS["steps"], lambda s: F.concat(F.lit("    "), s)),
        F.when(F.size(called) > 0, F.concat(head["calls"], F.array_join(called, ", "))),
    )
