"""Classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels.
TASK_LABELS = {"RUNNING": "执行中", "SUCCEEDED": "成功"}
TASK_OTHER = "失败"
STATUS_LABELS = {"passed": "通过", "failed": "失败", "ignored": "失败", "compile_error": "编译错误", "pending": "等待中", "no_tests": "无测试", "unknown": "未知"}
UNKNOWN_PROJECT, UNKNOWN_TOOL = "未知项目", "未知工具"
NAME_PATTERN = "^[\\u4e00-\\u9fa5a-zA-Z0-9_]+$"
MAX_NAME, MAX_DESCRIPTION = 64, 500


def test_status(task: Column, compiled: Column, passed: Column, failed: Column, ignored: Column) -> Column:
    """Six ways, in this order; an unknown compile result falls through."""
    return (
        F.when(task.isNull(), "pending")
        .when(compiled.eqNullSafe(F.lit(False)), "compile_error")
        .when(failed > 0, "failed")
        .when(passed > 0, "passed")
        .when(ignored > 0, "ignored")
        .otherwise("no_tests")
    )


def label(status: Column, labels: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, status), other)


def access(exists: Column, owner: Column, user: Column) -> Column:
    """404 where there is nothing, 403 for another's, else 200."""
    return F.when(~exists, 404).when(owner != user, 403).otherwise(200)


def valid_name(name: Column) -> Column:
    return F.rlike(F.coalesce(name, F.lit("")), F.lit(NAME_PATTERN)) & (F.char_length(name) <= MAX_NAME)


def valid_description(text: Column) -> Column:
    return F.coalesce(F.char_length(text) <= MAX_DESCRIPTION, F.lit(True))


def exactly_one(*flags: Column) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + flag.cast("int")
    return total == 1


def execution_title(error: Column, running: Column, progress: Column, compiled: Column, tested: Column) -> Column:
    return (
        F.when(error.isNotNull(), "执行出错")
        .when(running, F.when(progress < 50, "正在编译测试用例").otherwise("正在执行测试并收集数据"))
        .when(compiled.eqNullSafe(F.lit(False)), "编译失败")
        .when(tested, "执行完成")
        .otherwise("准备就绪")
    )


def failure_context(compiled: Column, failed: Column, stdout: Column, stderr: Column, compile_default: str, run_default: str) -> Column:
    pick = lambda text, default: F.coalesce(F.nullif(text, F.lit("")), F.lit(default))
    return F.when(compiled.eqNullSafe(F.lit(False)), pick(stderr, compile_default)).when(failed > 0, pick(stdout, run_default))


def outcome_counts(stdout: Column, exit_code: Column) -> Column:
    """STRUCT<passed, failed, ignored, total> of a test run's output; a crash without a failure counts as one."""
    count = lambda token: F.regexp_count(stdout, F.lit(token)).cast("long")
    failed = F.when((exit_code != 0) & (count(":FAIL") == 0), F.lit(1).cast("long")).otherwise(count(":FAIL"))
    passed, ignored = count(":PASS"), count(":IGNORE")
    return F.struct(passed.alias("passed"), failed.alias("failed"), ignored.alias("ignored"), (passed + failed + ignored).alias("total"))


def tri_state(hits: Column) -> Column:
    return F.when(hits.isNull(), "none").when(hits > 0, "hit").otherwise("missed")
