"""C sources: functions, test targets, and repairs of generated tests.

Functions are found from left to right and each consumes its lines, as do the blocks that repairs take out. A short file is walked in
its task; a long one is spread over tasks as blocks of lines.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import paths, text
from millrace.operators.blocks import OPEN, Lines
from millrace.operators.scans import Latest, Next, scan

# What a function's head looks like, what a line of code never starts with, words that aren't function names.
_HEAD = re.compile(r"(?:[a-zA-Z0-9_]+\s*\*?\s+)+([a-zA-Z0-9_]+)\s*\(([^)]*)\)")
_NOT_CODE = ("#", "//", "/*", "*", "}")
_NOT_NAMES = frozenset(("if", "while", "for", "switch", "return", "sizeof", "typedef", "struct"))
LOOK_AHEAD = 5
# What repairs of generated tests look for.
_TEST_HEAD, _RUN_TEST = r"^\s*void\s+(test_\w+)\s*\(", r"^\s*RUN_TEST\(\s*(\w+)\s*\)"
_IGNORE, _WEAK, _CALL_LIKE = "TEST_IGNORE_MESSAGE", "__attribute__((weak))", r"[a-zA-Z_]\w*\s*\("
_OUTLINE = r"^\s*(?:class|function|def|interface|const|let|var)\s+([a-zA-Z0-9_]+)"  # a declaration in an outline
_MOCK = r"^\s*static\s+.*\bmock_\w+\s*="
_STATIC, _MOCK_NAME, _SPACE = re.compile(r"\s*static\s+", re.ASCII), re.compile(r"mock_\w+\s*=", re.ASCII), " \t\n\r\x0b\x0c"

#: Characters of a file that a task walks by itself.
WALKED = 1 << 20

FUNCTION = "source_file string, function_id string, name string, start_line int, end_line int, signature string"


def _brace_line(lines: list[str], at: int) -> int | None:
    """Where the brace opens that belongs to the head on line ``at``: there, or first on one of the next lines."""
    if "{" in lines[at]:
        return at
    for k, following in enumerate(lines[at + 1 : at + 1 + LOOK_AHEAD], at + 1):
        following = following.strip()
        if following.startswith("{"):
            return k
        if following and (following[0] in ";#" or "(" in following):
            return None
    return None


def _close_line(lines: list[str], at: int) -> int | None:
    """The first line from ``at`` on where a brace has opened and none is open; braces count wherever they stand."""
    depth, opened = 0, False
    for k in range(at, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        opened = opened or "{" in lines[k]
        if opened and depth <= 0:
            return k
    return None


def find_functions(content: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, first line, last line, signature) of each function, lines from 1."""
    lines, at = content.split("\n"), 0
    while at < len(lines):
        line, step = lines[at].strip(), at + 1
        head = None if not line or line.startswith(_NOT_CODE) else _HEAD.match(line)
        if head and head[1] not in _NOT_NAMES:
            brace = _brace_line(lines, at)
            close = None if brace is None else _close_line(lines, brace)
            if close is not None:
                yield head[1], at + 1, close + 1, line.rstrip("{").strip()
                step = close + 1
        at = step


def _head_name(line: Column) -> Column:
    """The name that a line's head declares, null without a head: words, each but the last with a star or without, and an argument list.

    Read off the part before the first parenthesis by replacing what may stand between words, as a pattern over repeated words goes
    deep into the stack on long lines.
    """
    before = F.regexp_replace(F.substring_index(line, "(", 1), r"(?<=[a-zA-Z0-9_])\s*\*\s+(?=[a-zA-Z0-9_])", " ")
    names = F.split(text.strip(before), r"\s+")
    good = F.rlike(line, F.lit(r"^[^(]*\([^)]*\)")) & F.rlike(before, F.lit(r"^[a-zA-Z0-9_][a-zA-Z0-9_\s]*$")) & (F.size(names) > 1)
    return F.when(good & ~F.element_at(names, -1).isin(*_NOT_NAMES), F.element_at(names, -1))


def functions_of_lines(sources: DataFrame, path: str = "path", content: str = "content", limit: int | None = None) -> DataFrame:
    """(source_file, name, start_line, end_line, signature) of each function, files spread over tasks line by line."""
    stripped = text.strip(F.col("line"))
    begins = lambda *marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.startswith("bare", m))
    lines = Lines(sources.select(F.col(path).alias("source_file"), F.col(content).alias("content")), "source_file", "content", limit, bare=stripped)
    brace, stop = F.startswith("bare", F.lit("{")), begins(";", "#") | F.contains("bare", F.lit("("))
    here = F.struct("at", (F.col("opens") | brace).alias("opens"), "before", "total")
    rows = lines.rows.withColumn("name", F.when(~begins(*_NOT_CODE), _head_name(F.col("bare"))))
    soon = lines.following(rows, F.col("opens"), brace=F.when(brace | ((F.col("bare") != "") & stop), F.struct("at", brace.alias("opens"), "before", "total")))
    brace_ = F.when(F.col("opens"), here).otherwise(F.when(F.col("brace.opens") & (F.col("brace.at") - F.col("at") <= LOOK_AHEAD), F.col("brace")))
    heads = soon.filter("name IS NOT NULL").withColumn("brace", brace_).filter("brace IS NOT NULL")
    starts = heads.select("source_file", "at", "name", "bare", F.col("brace.before").alias("level"), F.col("brace.at").alias("opened"), F.col("brace.total").alias("reached"))
    found = lines.chosen(lines.ended(starts).filter("end IS NOT NULL"))
    return found.select("source_file", "name", (F.col("at") + 1).alias("start_line"), (F.col("end") + 1).alias("end_line"), text.strip(F.regexp_replace("bare", r"\{+$", "")).alias("signature"))


def functions(sources: DataFrame, path: str = "path", content: str = "content", walked: int = WALKED, limit: int | None = None) -> DataFrame:
    """The functions of each source file, with composite ids; files of more than ``walked`` characters are spread over tasks."""

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *f) for p, c in zip(part["path"], part["content"], strict=True) if c for f in find_functions(c)]
            yield pd.DataFrame(rows, columns=["source_file", "name", "start_line", "end_line", "signature"])

    rows = sources.select(F.col(path).alias("path"), F.col(content).alias("content"))
    short, long = rows.filter(F.length("content") <= walked), rows.filter(F.length("content") > walked)
    found = short.mapInPandas(find, "source_file string, name string, start_line int, end_line int, signature string")
    if not long.isEmpty():
        found = found.unionByName(functions_of_lines(long, limit=limit))
    return found.withColumn("function_id", text.encode_id(F.col("source_file"), F.col("start_line")))


def structure(sources: DataFrame, found: DataFrame) -> DataFrame:
    """Every file with its functions in order; files without any, JSON files too, have an empty array."""
    listed = found.groupBy(F.col("source_file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("start_line", "name", "end_line", "signature", "function_id"))).alias("functions"))
    empty = F.array().cast(listed.schema["functions"].dataType)
    return sources.select("path").join(listed, "path", "left").select("path", F.coalesce("functions", empty).alias("functions")).orderBy("path")


def header_of(files: DataFrame) -> DataFrame:
    """(path, header) of each ``.c`` file: the header with the same stem, else the only one of the same name anywhere."""
    lower = F.lower("path")
    c = files.filter(F.endswith(lower, F.lit(".c"))).select("path", paths.stem(F.col("path")).alias("full"), paths.stem(paths.basename(F.col("path"))).alias("short"))
    h = files.filter(F.endswith(lower, F.lit(".h"))).select(F.col("path").alias("header"), paths.stem(F.col("path")).alias("full"), paths.stem(paths.basename(F.col("path"))).alias("short"))
    same = h.groupBy("full").agg(F.min("header").alias("same"))
    only = h.groupBy("short").agg(F.min("header").alias("only"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return c.join(same, "full", "left").join(only, "short", "left").select("path", F.coalesce("same", "only").alias("header"))


def declarations(headers: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(header, name) of every name that a header declares, comments and preprocessor lines aside.

    A declaration is a statement that ends in a closing parenthesis and a semicolon; each name in it that an argument list follows
    is declared. Every header is read once.
    """
    clean = F.regexp_replace(text.strip_comments(F.col(content)), r"(?m)^\s*#.*$", "")
    pieces = headers.select(F.col(path).alias("header"), F.explode(F.split(clean, r"(?<=[;{}])")).alias("piece"))
    ended = pieces.filter(F.rlike("piece", F.lit(r"\)\s*;$")))
    return ended.select("header", F.explode(F.regexp_extract_all("piece", F.lit(r"(?<![\p{L}\p{N}_])([a-zA-Z0-9_]+)\s*\("), 1)).alias("name")).distinct()


def test_targets(files: DataFrame) -> DataFrame:
    """The functions of all ``.c`` files classified: ``optional`` for static ones, ``must`` with a reason for the others.

    Whether a header declares a function is an equi-join of (header, name) with the headers' declarations.
    """
    lower = F.lower("path")
    sources, headers = files.filter(F.endswith(lower, F.lit(".c"))), files.filter(F.endswith(lower, F.lit(".h")))
    rows = functions(sources).join(header_of(files).withColumnRenamed("path", "source_file"), "source_file", "left")
    rows = rows.join(declarations(headers).withColumn("_declared", F.lit(True)), ["header", "name"], "left")
    static, declared = text.is_static(F.col("signature")), F.coalesce("_declared", F.lit(False))
    reason = F.when(static, "internal_static").when(F.col("header").isNull(), "no_corresponding_header").when(~declared, "not_declared_in_header")
    return rows.select(
        "source_file", "function_id", "name", "start_line", "end_line", "signature", F.when(static, "optional").otherwise("must").alias("category"), F.when(~static, F.col("header")).alias("header_file"), (~static & declared).alias("declared_in_header"), reason.alias("reason")
    )


def target_counts(targets: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("category") == c)
    return targets.agg(n("must").alias("must_test"), n("optional").alias("optional_static"), n("skipped").alias("skipped"), F.count("*").alias("total"))


def test_summary(targets: DataFrame, results: DataFrame, key: Column) -> DataFrame:
    """Must-test functions with their latest results, status and order: coverage, then passed, then place."""
    from millrace.functions import status

    rows = targets.filter("category = 'must'").withColumn("result_key", key).join(results, "result_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    state = status.test_status(F.col("latest_task_id"), F.col("compile_success"), zero("passed"), zero("failed"), zero("ignored"))
    out = rows.withColumns({"status": state, "passed": zero("passed"), "failed": zero("failed"), "ignored": zero("ignored"), "line_coverage": F.coalesce("line_coverage", F.lit(0.0)), "branch_coverage": F.coalesce("branch_coverage", F.lit(0.0))})
    return out.orderBy(F.col("line_coverage").desc(), F.col("passed").desc(), "source_file", "start_line")


def resolve(functions_: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted (source_file, start_line, name) with the function of that line, else of that name."""
    by_line = functions_.select("source_file", "start_line", F.col("function_id").alias("_line"))
    by_name = functions_.groupBy("source_file", "name").agg(F.min_by("function_id", "start_line").alias("_name"))
    out = wanted.join(by_line, ["source_file", "start_line"], "left").join(by_name, ["source_file", "name"], "left")
    return out.select(*wanted.columns, F.coalesce("_line", "_name").alias("function_id"))


def _joined(rows: DataFrame, key: str, code: DataFrame, content: str) -> DataFrame:
    texts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("rows"))
    joined = texts.select(key, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias(content))
    return code.select(key).join(joined, key, "left").withColumn(content, F.coalesce(content, F.lit("")))


def _removed(lines: Lines, rows: DataFrame, starts: Column) -> DataFrame:
    """The lines with ``inside``: whether they belong to a block that one of ``starts`` opens. Blocks that never close go on to the end."""
    here = F.struct("at", "total")
    rows = lines.following(rows.withColumn("starts", F.coalesce(starts, F.lit(False))), F.col("opens"), brace=F.when(F.col("opens"), here))
    heads = rows.filter("starts").select(lines.key, "at", F.col("before").alias("level"), F.coalesce("brace.at", F.lit(OPEN)).alias("opened"), F.coalesce("brace.total", F.lit(OPEN)).alias("reached"))
    ended = lines.ended(heads).select(lines.key, "at", F.coalesce("end", F.lit(OPEN)).alias("end"))
    return lines.inside(lines.chosen(ended))


def _block_end(lines: list[str], at: int) -> int:
    """The last line of the block that opens on line ``at`` or later; the text's last one where it never closes."""
    close = _close_line(lines, at)
    return len(lines) - 1 if close is None else close


def _is_mock(line: str) -> bool:
    """Whether ``_MOCK`` finds something, in the reading of Spark's patterns: no dot for a line end, marks belong to words."""
    head = _STATIC.match(line)
    if not head:
        return False
    for m in _MOCK_NAME.finditer(line, head.end()):
        at = m.start()
        if re.search("[\r\u0085\u2028\u2029]", line[head.end() : at]):
            return False
        before = line[at - 1]
        while at and unicodedata.category(before) == "Mn":
            at -= 1
            before = line[at - 1] if at else " "
        if before != "_" and unicodedata.category(before) not in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"):
            return True
    return False


def _without_ignored(code: str) -> str:
    if _IGNORE not in code:
        return code
    lines, owner, ignored = code.split("\n"), None, set()
    heads = [re.match(_TEST_HEAD, line, re.ASCII) for line in lines]
    for line, head in zip(lines, heads, strict=True):
        owner = head[1] if head else owner
        if owner and _IGNORE in line:
            ignored.add(owner)
    out, at = [], 0
    while at < len(lines):
        head = heads[at]
        if head and head[1] in ignored:
            at = _block_end(lines, at)
        elif head or not (run := re.match(_RUN_TEST, lines[at], re.ASCII)) or run[1] not in ignored:
            out.append(lines[at])
        at += 1
    return "\n".join(out)


def _without_weak(code: str) -> str:
    if _WEAK not in code and "mock_" not in code:
        return code
    lines, out, at = code.split("\n"), [], 0
    while at < len(lines):
        line = lines[at]
        if _WEAK in line and (("{" in line and re.search(_CALL_LIKE, line, re.ASCII)) or any("{" in x for x in lines[at + 1 : at + 4])):
            at = _block_end(lines, at) + 1
            while at < len(lines) and not lines[at].strip(_SPACE):
                at += 1
            continue
        if not _is_mock(line):
            out.append(line)
        at += 1
    return "\n".join(out)


def _repaired(code: DataFrame, key: str, content: str, walk: Callable[[str], str], spread: Callable[[DataFrame], DataFrame], walked: int) -> DataFrame:
    """(key, content) of each text: those of up to ``walked`` characters are walked in their tasks, the others ``spread``; null counts as empty."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([walk(c or "") for c in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], [key, content])

    rows, length = code.select(key, content), F.coalesce(F.length(content), F.lit(0))
    done = rows.filter(length <= walked).mapInArrow(repair, f"`{key}` {rows.schema[key].dataType.simpleString()}, `{content}` string")
    long = rows.filter(length > walked)
    return done if long.isEmpty() else done.unionByName(spread(long))


def strip_ignored_tests(code: DataFrame, key: str = "id", content: str = "code", limit: int | None = None) -> DataFrame:
    """Without the test functions that hold an ignore message, and without the lines that run them; starts inside a function that goes are part of it.

    With a ``limit`` for the lines of a task all texts are spread, as those of more than ``WALKED`` characters are without it.
    """
    return _repaired(code, key, content, _without_ignored, lambda rows: _ignored_of_lines(rows, key, content, limit), WALKED if limit is None else -1)


def strip_weak_mocks(code: DataFrame, key: str = "id", content: str = "code", limit: int | None = None) -> DataFrame:
    """Without weak function bodies, the blank lines after them, and mock control variables; starts inside a body are part of it. ``limit`` as above."""
    return _repaired(code, key, content, _without_weak, lambda rows: _weak_of_lines(rows, key, content, limit), WALKED if limit is None else -1)


def _ignored_of_lines(code: DataFrame, key: str, content: str, limit: int | None) -> DataFrame:
    head = F.nullif(F.regexp_extract("line", _TEST_HEAD, 1), F.lit(""))
    run = F.nullif(F.regexp_extract("line", _RUN_TEST, 1), F.lit(""))
    lines = Lines(code, key, content, limit, head=head, mention=F.coalesce(head, run))
    rows = scan(lines.rows, key, ["at"], lines.slices, owner=Latest(F.col("head")))
    ignored = rows.filter(F.contains("line", F.lit(_IGNORE)) & F.col("owner").isNotNull()).select(key, F.col("owner").alias("mention"), F.lit(True).alias("hit")).distinct()
    lines.rows = lines.rows.join(ignored, [key, "mention"], "left")
    kept = _removed(lines, lines.rows, F.col("head").isNotNull() & F.col("hit"))
    return _joined(kept.filter(~F.col("inside") & ~(F.col("head").isNull() & F.coalesce("hit", F.lit(False)))), key, code, content)


def _weak_of_lines(code: DataFrame, key: str, content: str, limit: int | None) -> DataFrame:
    lines = Lines(code, key, content, limit, weak=F.contains("line", F.lit(_WEAK)))
    rows = scan(lines.rows, key, ["at"], lines.slices, _open=Next(F.when(F.col("opens"), F.col("at"))))
    here = F.col("opens") & F.rlike("line", F.lit(_CALL_LIKE))
    soon = F.coalesce(F.col("_open") - F.col("at") <= 3, F.lit(False))
    blocks = _removed(lines, rows.withColumn("weak", F.col("weak") & (here | soon)).drop("_open"), F.col("weak"))
    blank = text.strip(F.col("line")) == ""
    kept = scan(blocks, key, ["at"], lines.slices, _solid=Latest(F.when(F.col("inside") | ~blank, F.col("inside"))))
    trailing = blank & F.coalesce("_solid", F.lit(False))
    return _joined(kept.filter(~F.col("inside") & ~trailing & ~F.rlike("line", F.lit(_MOCK))), key, code, content)


def outline(code: DataFrame, key: str = "id", content: str = "code") -> DataFrame:
    """Classes, functions, interfaces and variables by the look of their lines: key, line, name, kind."""
    rows = code.select(key, F.posexplode(F.split(content, "\n")).alias("at", "text"))
    name = F.regexp_extract("text", _OUTLINE, 1)
    has = lambda what: F.contains("text", F.lit(what))
    kind = F.when(has("class"), "class").when(has("function") | has("def"), "function").when(has("interface"), "interface").otherwise("variable")
    return rows.withColumn("name", name).filter("name <> ''").select(key, (F.col("at") + 1).alias("line"), "name", kind.alias("kind"))
