"""JSON access logs: lines from files, requests from lines."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from footfall.functions.once import evaluate_once
from footfall.functions.text import is_blank, non_empty
from footfall.functions.times import millis_of_seconds
from footfall.schemas import RAW_REQUEST
from footfall.session import prepare

# Strict JSON: no bare NaN, no single quotes.
_JSON_OPTIONS = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


_TEXTS = ", ".join(f"{name}: string" for name in ("host", "method", "uri", "client_ip", "remote_ip"))
# The fields a request needs; everything else in a line is skipped unparsed.
_LINE = (
    f"ts double, status int, request struct<{_TEXTS}, "
    "headers: struct<`User-Agent`: array<string>, Referer: array<string>>>"
)


_JSON_NUMBER = r"\A-?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?\z"

_TEXT_FIELDS = {
    "host": "request.host",
    "method": "request.method",
    "uri": "request.uri",
    "client_ip": "request.client_ip",
    "remote_ip": "request.remote_ip",
    "user_agent": "request.headers['User-Agent'][0]",
    "referrer": "request.headers.Referer[0]",
}
# Where the type of a value decides: a second one of another type would be skipped instead of taken.
_TYPED_KEYS = ("ts", "status", "request", "headers", "User-Agent", "Referer")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per line of every file; files split freely, only a newline ends a line."""
    return prepare(spark).read.option("lineSep", "\n").text(paths)


def stream_lines(reader: DataStreamReader, path: str) -> DataFrame:
    """The same lines from segments as they arrive in a directory."""
    return reader.option("lineSep", "\n").text(path)


def clean_lines(lines: DataFrame) -> DataFrame:
    """Drop trailing carriage returns and blank lines."""
    value = F.col("value")
    stripped = F.when(value.endswith("\r"), F.rtrim(value, F.lit("\r"))).otherwise(value)
    return lines.filter(value.contains("{") | ~is_blank(value)).withColumn("value", stripped)


def _plain(name: str) -> Column:
    """One field of the fast reading; of a header, its first value."""
    path, of_header, _ = f"plain.{_TEXT_FIELDS[name]}".partition("[0]")
    value = F.col(path.replace("['User-Agent']", ".`User-Agent`"))
    return F.get(value, F.lit(0)) if of_header else value


def _whole(name: str, kind: str = "variant") -> Column:
    return F.try_variant_get("whole", f"$.{_TEXT_FIELDS.get(name, name)}", kind)


def _whole_type(name: str) -> Column:
    return F.schema_of_variant(_whole(name))


def _looks_like_no_text(text: Column) -> Column:
    """Whether text is what a JSON value other than a string reads as; addresses rarely reach the pattern."""
    like_a_number = (text.between("0", "9~") | text.startswith("-")) & (F.substring_index(text, ".", 2) == text)
    structured = text.startswith("{") | text.startswith("[") | text.isin("true", "false")
    return F.coalesce(structured | (like_a_number & text.rlike(_JSON_NUMBER)), F.lit(False))


def _may_repeat_a_key() -> Column:
    """Whether a key whose value's type decides occurs twice, or some key may be spelt with escapes."""
    twice = [F.expr(f"locate('\"{key}\"', value, locate('\"{key}\"', value) + 1) > 0") for key in _TYPED_KEYS]
    escaped = F.col("value").contains("\\u00") & F.col("value").rlike(r"\\u00[4-7]")
    return reduce(or_, twice) | escaped


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every line with its request fields; `conforming` is false where no request could be read.

    The fast reading takes strings as strings, but turns a JSON 12 into "12", and of a key that occurs twice it
    skips a last value of another type. Only lines where some field looks like that, or where such a key may occur
    twice, are read again as a whole with their JSON types, where the last of equal keys counts at any depth.
    """
    read = lines.withColumn("plain", F.from_json("value", _LINE, _JSON_OPTIONS))
    doubtful = reduce(or_, [_looks_like_no_text(_plain(name)) for name in _TEXT_FIELDS]) | _may_repeat_a_key()
    read = read.withColumn("doubtful", doubtful)
    read = read.withColumn("whole", F.when(F.col("doubtful"), F.try_parse_json("value")))

    def field(plain: Column, name: str, types: str, kind: str) -> Column:
        typed = F.when(_whole_type(name).rlike(types), _whole(name, kind))
        return F.when(F.col("doubtful"), typed).otherwise(plain)

    fields = {name: field(_plain(name), name, "^STRING$", "string") for name in _TEXT_FIELDS}
    text = {name: non_empty(value) for name, value in fields.items()}
    ts = field(F.col("plain.ts"), "ts", "^(BIGINT|DECIMAL|FLOAT|DOUBLE)", "double")
    parsed = evaluate_once(
        host=text["host"],
        method=text["method"],
        uri=text["uri"],
        status=field(F.col("plain.status"), "status", "^BIGINT$", "int"),
        remote_ip=F.coalesce(text["client_ip"], text["remote_ip"]),
        referrer=fields["referrer"],
        user_agent=F.coalesce(fields["user_agent"], F.lit("")),
        ts=F.when(F.abs(ts) < float("inf"), ts),
    )
    conforming = F.lit(True)
    for needed in ("host", "method", "uri", "status", "remote_ip", "ts"):
        conforming = conforming & F.col(needed).isNotNull()
    return read.select(parsed).select(
        "host",
        "method",
        F.substring_index("uri", "?", 1).alias("path"),
        "status",
        "remote_ip",
        "referrer",
        "user_agent",
        F.timestamp_millis(millis_of_seconds(F.col("ts"))).alias("at"),
        conforming.alias("conforming"),
    )


def conforming_requests(parsed: DataFrame) -> DataFrame:
    """Requests read from lines that hold one, with a time the calendar holds."""
    return parsed.filter("conforming AND at IS NOT NULL").select(*RAW_REQUEST.fieldNames())
