"""Small text, parsing and timing rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of each enumeration, as configuration files have them; letter case counts.
VERSIONS = {"v5": "v5", "yolov5": "v5", "v8": "v8", "yolov8": "v8", "v11": "v11", "yolo11": "v11", "v26": "v26", "yolo26": "v26"}
BACKENDS = {"cuda": "cuda", "trt": "cuda", "tensorrt": "cuda", "ascend": "ascend", "acl": "ascend", "cpu": "cpu", "mps": "mps", "metal": "mps"}
TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")
SAFE = "^[A-Za-z0-9_-]+$"


def enum_of(text: Column, spellings: dict[str, str]) -> Column:
    """The value of a spelling, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.try_element_at(table, text)


def boolean_of(text: Column) -> Column:
    """True or false in one of their spellings, else null."""
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def integer_of(text: Column) -> Column:
    """The whole number that a text begins with, white space aside; null where there is none or it is out of a 32-bit range."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def float_of(text: Column) -> Column:
    """The number that a text begins with, white space aside, as a 32-bit float; null where there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("float")


def comma_list(text: Column) -> Column:
    """Parts of a comma list without spaces and without empty parts."""
    return F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ","), lambda x: x != "")


def url_join(base: Column, key: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), key)


def with_transport(url: Column) -> Column:
    """An rtsp url that asks for tcp, unless it names a transport."""
    return F.when(url.contains("rtsp_transport="), url).otherwise(F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("rtsp_transport=tcp")))


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x1f\x7f]")


def placeholder_error(template: Column) -> Column:
    """Why a template cannot be filled in, by its first brace that begins neither {task_id} nor {source_id}; null where it can, and for null."""
    rest = F.regexp_extract(template, r"(?s)\{(?!(?:task_id|source_id)\})(.*)$", 0)
    token = F.regexp_extract(rest, r"(?s)^(\{[^}]*\})", 1)
    return F.when(rest == "", None).when(token == "", "unterminated placeholder").when(token != "", F.concat(F.lit("unsupported placeholder "), token))


def placeholders(template: Column, task: Column, source: Column) -> Column:
    """The template with {task_id} and {source_id} filled in, once: braces in the names stay; null where there is a placeholder_error."""
    parts = F.transform(F.split(template, r"\{task_id\}"), lambda p: F.replace(p, F.lit("{source_id}"), source))
    return F.when(placeholder_error(template).isNull(), F.call_function("array_join", parts, task))


def backoff(base: Column, ceiling: Column, failures: Column, jitter: Column) -> Column:
    """Milliseconds before a reconnect: doubled up to six times, at most the ceiling, moved by up to a tenth, never under the base."""
    wait = F.least(base * F.pow(F.lit(2), F.least(failures, F.lit(6))).cast("bigint"), ceiling)
    return F.greatest(base.cast("double"), wait * (1 + jitter * 0.1))


def sink_backoff(first: Column, most: Column, failures: Column) -> Column:
    return F.least(first * F.pow(F.lit(2), failures).cast("bigint"), most)


def stop_reconnecting(failures: Column, most: Column) -> Column:
    return F.when(most == 0, False).otherwise(failures >= most)


def fault_of(code: Column) -> Column:
    """Fault type of an error code (fixed values): memory failures, lost contexts, all others faults of the engine."""
    return F.when(code == 2, "oom").when(code.isin(101, 201), "context_lost").otherwise("engine_fault")


def bucket_end(day: Column, hour: Column, minute: Column) -> Column:
    """UTC seconds at which an archive's minute folder ends, from the names of its day, hour and minute folders; null unless all are well formed.

    A day beyond its month's end counts on into the next one."""
    good = day.rlike(r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$") & hour.rlike(r"^([01]\d|2[0-3])$") & minute.rlike(r"^[0-5]\d$")
    part = lambda at, n: F.when(good, F.substring(day, at, n)).try_cast("int")
    days = F.unix_date(F.make_date(part(1, 4), part(5, 2), F.lit(1))) + part(7, 2) - 1
    return F.when(good, days.cast("bigint") * 86400 + hour.try_cast("int") * 3600 + minute.try_cast("int") * 60 + 60)


def time_text(at: Column, stream: Column | None = None) -> Column:
    """Local time with milliseconds, behind the stream's name unless that is empty or not asked for."""
    text = F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS")
    return text if stream is None else F.when(F.coalesce(stream, F.lit("")) == "", text).otherwise(F.concat(stream, F.lit(" "), text))
