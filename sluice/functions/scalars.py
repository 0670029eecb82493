"""Column functions used by transforms."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.values import variant_path

# Date layouts given by example, and strftime marks, as Spark patterns.
EXAMPLE_LAYOUT = {
    "2006": "yyyy", "01": "MM", "02": "dd", "15": "HH", "04": "mm", "05": "ss",
    "Z07:00": "XXX", "-07:00": "xxx", "MST": "z", "Jan": "MMM", "Mon": "EEE", ".000": ".SSS",
}
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy"}
RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"

# Fixed value: the common log format of web servers.
COMMON_LOG = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)'
COMMON_LOG_FIELDS = ("host", "identity", "user", "timestamp", "request", "status", "size")


def date_pattern(layout: str) -> str:
    """Spark date pattern for a layout by example, a strftime format, or a Spark pattern."""
    table = STRFTIME if "%" in layout else EXAMPLE_LAYOUT if "2006" in layout or "15:04" in layout else None
    if table is None:
        return layout
    marks = sorted(table, key=len, reverse=True)
    pieces = re.split("(" + "|".join(map(re.escape, marks)) + ")", layout)
    return "".join(table.get(p) or re.sub(r"([A-Za-z]+)", r"'\1'", p) for p in pieces if p)


def parse_json(text: Column, schema: str | None = None) -> Column:
    """JSON text as a VARIANT, or as ``schema``; NULL when it does not parse."""
    return F.from_json(text, schema) if schema else F.try_parse_json(text)


def json_object(text: Column) -> Column:
    """JSON text as a VARIANT when it is one object and nothing else, else NULL.

    The parser stops at the end of the first value it meets.  A text whose only closing brace is its last sign has nothing behind that
    value.  Any other is read as the only item of an array; where the array may end before the text does, the text must also be
    readable as the value of a key, since what ends an array does not end an object.
    Of repeated keys the last counts where ``spark.sql.variant.allowDuplicateKeys`` is on.
    """
    flat = text.rlike(r"^\s*\{[^}]*\}\s*$")
    parsed = F.try_parse_json(F.when(flat, text).otherwise(F.concat(F.lit("["), text, F.lit("]"))))
    items = F.try_variant_get(parsed, "$", "array<variant>")
    keyed = F.map_keys(F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"_":'), text, F.lit("}"))), "$", "map<string,variant>"))
    ends = F.when(text.rlike(r"\}\s*\]"), F.coalesce(F.size(keyed) == 1, F.lit(False))).otherwise(F.lit(True))
    return F.when(flat, parsed).when(text.rlike(r"^\s*\{") & (F.size(items) == 1) & ends, F.get(items, 0))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, RFC3339)


def now_rfc3339() -> Column:
    return rfc3339(F.current_timestamp())


def dated_name(prefix: str, ts: Column, layout: str = "%Y-%m-%d") -> Column:
    """A name with a date in it, such as ``logs-2024-01-31``."""
    return F.concat(F.lit(prefix), F.date_format(ts, date_pattern(layout)))


def choose(*cases: tuple[Column, object], otherwise=None) -> Column:
    """if / else if / else."""
    out = F.when(cases[0][0], cases[0][1])
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def env(name: str, default: str = "") -> Column:
    """Environment variable of the driver as a literal."""
    return F.lit(os.environ.get(name, default))


def regex_groups(column: Column, pattern: str) -> dict[str, Column]:
    """Named groups of ``pattern`` as columns; all NULL when the pattern does not match."""
    named = re.findall(r"\(\?P?<([A-Za-z_]\w*)>", pattern)
    java = re.sub(r"\(\?P<", "(?<", pattern)
    order = re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", java)).groupindex
    return {n: F.when(column.rlike(java), F.regexp_extract(column, java, order[n])) for n in named}


def common_log(column: Column) -> dict[str, Column]:
    """The seven fields of a common-log line; all NULL when the line has another form."""
    hit = column.rlike(COMMON_LOG)
    return {name: F.when(hit, F.regexp_extract(column, COMMON_LOG, i))
            for i, name in enumerate(COMMON_LOG_FIELDS, 1)}


def pick(values: list, index: Column) -> Column:
    """Item ``index mod len`` of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def random_int(bound: int, seed: int | None = None) -> Column:
    return F.floor(F.rand(seed) * bound).cast("bigint")


def json_path(document: Column, path: str, default: str = "") -> Column:
    """Text at a path with array indexes (``items.0.name``); numbers print without decimals."""
    value = F.try_variant_get(document, variant_path(path, indexes=True), "variant")
    kind = F.schema_of_variant(value)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    number = F.format_string("%.0f", F.try_variant_get(value, "$", "double"))
    text = F.when(numeric, number).otherwise(F.try_variant_get(value, "$", "string"))
    return F.when(value.isNull() | F.is_variant_null(value), F.lit(default)).otherwise(text)


def query_path(document: Column, path: str) -> Column:
    """Path subset of a jq query (``.a.b[0].c``) as a VARIANT."""
    return F.try_variant_get(document, "$" + path if path.startswith(".") else f"$.{path}", "variant")


_TEMPLATE = re.compile(r"\{\{\s*\.?([\w.]+)\s*\}\}|\$\{!\s*json\(\"([\w.]+)\"\)\s*\}")


def template(text: str, field=F.col) -> Column:
    """``{{name}}``, ``{{ .name }}`` and ``${!json("name")}`` filled from columns; NULL prints ''."""
    parts, at = [], 0
    for hit in _TEMPLATE.finditer(text):
        if hit.start() > at:
            parts.append(F.lit(text[at:hit.start()]))
        parts.append(F.coalesce(field(hit.group(1) or hit.group(2)).cast("string"), F.lit("")))
        at = hit.end()
    if at < len(text):
        parts.append(F.lit(text[at:]))
    return F.concat(*parts) if parts else F.lit("")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def bytes_to_text(column: Column) -> Column:
    return column.cast("string")


def within_last(ts: Column, now: Column, days: int) -> Column:
    """``ts`` lies in the ``days`` before ``now``."""
    return ts >= now - F.expr(f"INTERVAL {int(days)} DAYS")


def record_json(df: DataFrame) -> Column:
    """The whole record as one JSON object."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def require(column: Column, message: str) -> Column:
    """The column, failing the job where it is NULL.  For checks asked for as hard errors."""
    return F.when(column.isNull(), F.raise_error(F.lit(message)).cast("string")).otherwise(column)
