"""Column functions over log text: level, error type, error test, stack lines, timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What is looked for in log lines.
LEVEL = r"(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b"
ERROR_WORDS = "error exception failed fatal crash panic died 错误 异常 失败 崩溃 死机 宕机 故障 中断".split()
WARN_WORDS = "warn warning alert caution 警告 注意 提醒 告警".split()
MORE_ERROR_WORDS = [*ERROR_WORDS, "timeout", "超时"]
ERROR_PATTERNS = (
    ("Java Exception", r'(?i)(?:Exception|Error)(?:\s+in\s+thread\s+"[^"]*")?\s*:\s*(.+)'),
    ("Python Exception", r"(?i)(\w+Error|\w+Exception):\s*(.+)"),
    ("Http Error", r"(?i)HTTP\s+(\d{3,})\s*[:\-]?\s*(.+)"),
    ("Timeout Error", r"(?i)(?:timeout|timed?\s+out)(?:\s*:?\s*(.+))?"),
    ("Go Panic", r"(?i)panic:\s*(.+)"),
    ("Nodejs Error", r"(?i)(?:Error|TypeError|ReferenceError):\s*(.+)"),
    ("Database Error", r"(?i)(?:SQL|Database|Connection)\s*(?:Error|Exception):\s*(.+)"),
    ("Connection Error", r"(?i)(?:connection|connect)(?:\s+(?:failed|refused|reset|timeout))(?:\s*:?\s*(.+))?"),
    ("Memory Error", r"(?i)(?:out of memory|oom|memory exhausted)"),
    ("Disk Error", r"(?i)(?:no space left|disk full|filesystem full)"),
)
STACK_STARTS = ("    at ", "  File ", "Traceback", "goroutine", "\tat")
STACK_SIGNS = (".java:", ".py:", ".go:", "()", ".js:", "line ", "Line ", "at ", "File ")
STACK = r'^\s*at\s+|^\s*File\s+"|^\s*Traceback'
STAMP = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}|\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}|[A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}:\d{2})"
LEVEL_RANKS = {"FATAL": 5, "ERROR": 4, "WARN": 3, "WARNING": 3, "INFO": 2, "DEBUG": 1, "TRACE": 0}


def any_word(text: Column, words: list[str]) -> Column:
    """Whether one of the words occurs, as one alternation."""
    return F.rlike(text, F.lit("|".join(words)))


def log_level(line: Column) -> Column:
    """The level named in the first 100 characters, else what words of the first 200 suggest."""
    named = F.upper(F.regexp_extract(F.substring(line, 1, 100), LEVEL, 1))
    low = F.lower(F.substring(line, 1, 200))
    return F.when(named != "", named).when(any_word(low, ERROR_WORDS), "ERROR").when(any_word(low, WARN_WORDS), "WARN").otherwise("INFO")


def level_rank(level: Column) -> Column:
    rank = F.lit(1)
    for name, value in LEVEL_RANKS.items():
        rank = F.when(level == name, value).otherwise(rank)
    return rank


def error_type(line: Column, patterns=ERROR_PATTERNS) -> Column:
    """The first pattern that matches; null for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(F.rlike(line, F.lit(pattern)), name).otherwise(out)
    return out


def contains_error(line: Column) -> Column:
    named = [p for n, p in ERROR_PATTERNS if n in ("Java Exception", "Python Exception", "Go Panic", "Nodejs Error", "Http Error")]
    hit = any_word(F.lower(line), MORE_ERROR_WORDS)
    for pattern in named:
        hit = hit | F.rlike(line, F.lit(pattern))
    return hit


def is_stack_line(line: Column) -> Column:
    """A line that starts like one of a trace; or that is indented, has over ten characters and a sign of a call or a
    file; or that matches one of three patterns."""
    starts = F.lit(False)
    for start in STACK_STARTS:
        starts = starts | F.startswith(line, F.lit(start))
    signs = F.lit(False)
    for sign in STACK_SIGNS:
        signs = signs | F.contains(line, F.lit(sign))
    indented = F.rlike(line, F.lit(r"^[ \t]")) & (F.length(stripped(line)) > 10)
    return starts | (indented & signs) | F.rlike(line, F.lit(STACK))


def stripped(line: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def log_time(line: Column, year: int | None = None) -> Column:
    """The time stamp in the first 100 characters, its offset honoured; those without a year take ``year``."""
    stamp = F.regexp_extract(F.substring(line, 1, 100), STAMP, 1)
    tries = [F.try_to_timestamp(F.regexp_replace(stamp, ",", ".")), F.try_to_timestamp(stamp, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(stamp, F.lit("dd/MM/yyyy HH:mm:ss"))]
    if year is not None:
        tries.append(F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(stamp, " +", " ")), F.lit("yyyy MMM d HH:mm:ss")))
    return F.when(stamp != "", F.coalesce(*tries))
