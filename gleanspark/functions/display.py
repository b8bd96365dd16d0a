"""Display columns of the console's lists: dates, labels, names, placeholders, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task states, their labels and style classes.
PENDING, BEGIN, IN_PROGRESS, COMPLETED, FAILED, KILL = 0, 1, 2, 3, -1, -2
STATUS_LABELS = {
    PENDING: "待启动",
    BEGIN: "启动中",
    IN_PROGRESS: "运行中",
    COMPLETED: "已完成",
    FAILED: "失败",
    KILL: "已停止",
}
UNKNOWN_LABEL = "未知"
STATUS_CLASSES = {
    PENDING: "pending",
    BEGIN: "running",
    IN_PROGRESS: "running",
    COMPLETED: "completed",
    FAILED: "failed",
    KILL: "stopped",
}
ROLE_SUPERUSER = "管理员"
ROLE_USER = "普通用户"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _pick(value: Column, choices: dict[int, str], default: str) -> Column:
    chosen = F.lit(default)
    for key, text in choices.items():
        chosen = F.when(value == key, F.lit(text)).otherwise(chosen)
    return chosen


def format_time(value: Column | str) -> Column:
    """``yyyy/MM/dd HH:mm``, or ``-`` when there is no time."""
    return F.coalesce(F.date_format(_col(value), "yyyy/MM/dd HH:mm"), F.lit("-"))


def truncate_text(value: Column | str, n: int = 50) -> Column:
    """The first ``n`` characters and ``...`` if there are more; NULL becomes empty."""
    n = n or 50
    text = F.coalesce(_col(value), F.lit(""))
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def status_label(value: Column | str) -> Column:
    return _pick(_col(value), STATUS_LABELS, UNKNOWN_LABEL)


def status_class(value: Column | str) -> Column:
    return _pick(_col(value), STATUS_CLASSES, STATUS_CLASSES[PENDING])


def display_name(full_name: Column | str = "full_name", email: Column | str = "email") -> Column:
    """Full name, else email, else empty; an empty name counts as none."""
    return F.coalesce(F.nullif(_col(full_name), F.lit("")), _col(email), F.lit(""))


def name_initial(full_name: Column | str = "full_name", email: Column | str = "email") -> Column:
    """Upper-case first character of the display name."""
    return F.upper(F.substring(display_name(full_name, email), 1, 1))


def role_label(is_superuser: Column | str = "is_superuser") -> Column:
    return F.when(_col(is_superuser), F.lit(ROLE_SUPERUSER)).otherwise(F.lit(ROLE_USER))


def email_local(email: Column | str = "email") -> Column:
    """The part before the first ``@``; NULL becomes empty."""
    return F.coalesce(F.substring_index(_col(email), "@", 1), F.lit(""))


def dash_if_empty(value: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(value), F.lit("")), F.lit("-"))


# Message texts.


def duplicate_task_message(task_group: Column | str, task_name: Column | str) -> Column:
    return F.format_string("该任务已在系统中存在：[%s - %s]", _col(task_group), _col(task_name))


def duplicate_name_message(task_name: Column | str) -> Column:
    return F.format_string("该任务名称 [%s] 重复，请更换名称。", _col(task_name))


def published_message(table_name: Column | str, record_id: Column | str) -> Column:
    return F.format_string("Ghost 发送成功：%s - %s", _col(table_name), _col(record_id).cast("string"))


def publish_failed_message(response_text: Column | str) -> Column:
    return F.format_string("Ghost 服务返回错误: %s", _col(response_text))


UNREACHABLE_MESSAGE = "无法连接到 Ghost 服务"


def outcome_message(outcome: Column | str, parts: dict[str, Column]) -> Column:
    """The message of each outcome code: ``parts`` maps a code to its message column."""
    message = F.lit(None).cast("string")
    for code, text in parts.items():
        message = F.when(_col(outcome) == code, text).otherwise(message)
    return message
