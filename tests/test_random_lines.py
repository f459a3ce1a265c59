"""Random log lines, whole and broken, against the parsing rules written out in plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from footfall.operators.requests import kept_requests
from footfall.sources.access_log import clean_lines, conforming_requests, parse_lines

TEXTS = ["a", "", "12", "-1.5e3", "true", "null", "{x", "[1]", "é\"\\\n", "/p?q?r", "?", "/wp-admin", "/x.css", "GET", "POST", "203.0.113.7", "::1", " "]
OTHERS = [None, True, False, 0, 12, -7, 200, 404, 1.5, 200.0, 1e3, 12345678901, [], ["x"], [1], [None], {}, {"a": "b"}, [["x"]], [{"k": 1}], ["12"], ["{y"], [""]]
NAMES = ["host", "method", "uri", "client_ip", "remote_ip"]


def random_line(rng):
    def value(usual):
        roll = rng.random()
        return usual if roll < 0.75 else rng.choice(TEXTS) if roll < 0.88 else rng.choice(OTHERS)

    request = {name: value(rng.choice(["h.example", "GET", "/p?a=1", "203.0.113.7", "POST"])) for name in NAMES if rng.random() < 0.93}
    request["headers"] = value({"User-Agent": value([rng.choice(TEXTS)]), "Referer": value([rng.choice(TEXTS)]), "Cookie": ["c"]})
    document = {"ts": value(1760000000.25), "status": value(200), "msg": "m", "request": value(request), "size": 1}
    items = list(document.items())
    rng.shuffle(items)
    text = json.dumps(dict(items), ensure_ascii=rng.random() < 0.5)
    roll = rng.random()
    if roll < 0.06:
        return text[: rng.randrange(len(text))]
    if roll < 0.1:
        return text + rng.choice([" trailing", "{}", "]", ","])
    if roll < 0.13:
        place = rng.randrange(len(text))
        return text[:place] + rng.choice("{}[],:\"'0x") + text[place + 1 :]
    return text


def fail(token):
    raise ValueError(token)


def expected(line):
    """The request in a line, or None."""
    try:
        document, _ = json.JSONDecoder(parse_constant=fail).raw_decode(line)
    except ValueError:
        return None
    if not isinstance(document, dict) or not isinstance(document.get("request"), dict):
        return None
    request, ts, status = document["request"], document.get("ts"), document.get("status")
    if isinstance(ts, bool) or not isinstance(ts, (int, float)) or type(status) is not int or abs(status) > 2**31 - 1:
        return None

    def text(name):
        found = request.get(name)
        return found if isinstance(found, str) and found else None

    def header(name):
        headers = request.get("headers")
        values = headers.get(name) if isinstance(headers, dict) else None
        first = values[0] if isinstance(values, list) and values else None
        return first if isinstance(first, str) else None

    address = text("client_ip") or text("remote_ip")
    if not (text("host") and text("method") and text("uri") and address):
        return None
    path = text("uri").split("?", 1)[0]
    return (text("host"), text("method"), path, status, address, header("Referer"), header("User-Agent") or "", int(ts * 1000))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_parsing(spark, seed):
    rng = random.Random(seed)
    lines = [random_line(rng) for _ in range(3000)]
    rows = spark.createDataFrame([(line,) for line in lines], "value string")
    found = conforming_requests(parse_lines(clean_lines(rows)))
    found = found.select(*[name for name in found.columns if name != "at"], F.unix_millis("at")).collect()
    wanted = [request for request in map(expected, lines) if request is not None]
    assert len(wanted) > 500
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_the_same_lines_through_the_filter_never_fail(spark):
    rng = random.Random(4)
    lines = [random_line(rng) for _ in range(3000)]
    rows = spark.createDataFrame([(line,) for line in lines], "value string")
    assert 0 < kept_requests(parse_lines(clean_lines(rows)), {"::1"}).count() < 3000
