import pytest
from conftest import UA, line

from footfall.operators.reports import consumed_per_file, drop_reasons
from footfall.operators.requests import judge, kept_requests, unstorable
from footfall.sources.access_log import clean_lines, parse_lines, read_lines

RELAY = "203.0.113.50"


@pytest.fixture
def reason(lines):
    def run(**fields):
        return judge(parse_lines(clean_lines(lines(line(**fields)))), {RELAY}).first().drop_reason

    return run


def agent(text):
    return f'"User-Agent":["{text}"]'


@pytest.mark.parametrize(
    "fields, expected",
    [
        ({}, None),
        ({"uri": "/report?x=.css"}, None),
        ({"uri": "/LOGO.PNG"}, None),
        ({"method": "POST", "uri": "/api/order"}, None),
        ({"method": "POST", "uri": "/apiary"}, None),
        ({"headers": agent("")}, None),
        ({"headers": '"Accept":["x"]'}, None),
        ({"status": "204"}, None),
        ({"address": f'"client_ip":"{RELAY}"'}, "internal_proxy"),
        ({"address": f'"client_ip":"{RELAY}"', "status": "500"}, "internal_proxy"),
        ({"status": "404"}, "status"),
        ({"status": "500", "headers": agent("curl/8.11.1")}, "status"),
        ({"status": "302"}, "status"),
        ({"status": "199"}, "status"),
        ({"status": "300"}, "status"),
        ({"headers": agent("Mozilla/5.0 (compatible; Googlebot/2.1)")}, "bot"),
        ({"headers": agent("curl/8.11.1")}, "bot"),
        ({"headers": agent("python-requests/2.32")}, "bot"),
        ({"headers": agent("Java/17.0"), "uri": "/wp-admin/"}, "bot"),
        ({"uri": "/wp-login.php"}, "scan"),
        ({"uri": "/WP-Admin/"}, "scan"),
        ({"uri": "/wp-content/uploads/x.php"}, "scan"),
        ({"uri": "/wp-json/posts"}, "scan"),
        ({"uri": "/xmlrpc.php"}, "scan"),
        ({"uri": "/old/wordpress/setup"}, "scan"),
        ({"uri": "/wp-ſomething/wordpreſs"}, "scan"),
        ({"uri": "//blog/", "headers": agent(UA) + ',"Referer":["https://x.example/wp-login.php"]'}, "scan"),
        ({"uri": "/api/report"}, "noise"),
        ({"uri": "/healthz"}, "noise"),
        ({"uri": "/readyz"}, "noise"),
        ({"uri": "/app.css"}, "noise"),
        ({"uri": "/app.js?v=1"}, "noise"),
        ({"uri": "/favicon.ico"}, "noise"),
        ({"uri": "/robots.txt"}, "noise"),
        ({"uri": "/f.woff2"}, "noise"),
        ({"method": "POST", "uri": "/login"}, "post_outside_api"),
        ({"method": "HEAD"}, "method"),
        ({"method": "OPTIONS"}, "method"),
        ({"method": "get"}, "method"),
        ({"host": ""}, "not_a_request"),
        ({"uri": "?x"}, "empty_path"),
        ({"ts": "1e300"}, "time_out_of_range"),
        ({"uri": "/" + "x" * 511}, None),
        ({"uri": "/" + "x" * 5000}, None),
        ({"headers": agent(UA) + ',"Referer":["' + "y" * 600 + '"]'}, None),
    ],
)
def test_drop_reason(reason, fields, expected):
    assert reason(**fields) == expected


def test_engaged(lines):
    sent = lines(line(), line(method="POST", uri="/api/order"), line(method="POST", uri="/apiary"), line(method="POST", uri="/x"))
    kept = kept_requests(parse_lines(clean_lines(sent)))
    assert sorted((row.path, row.engaged) for row in kept.collect()) == [("/", False), ("/api/order", True), ("/apiary", True)]


def test_reject_report(lines):
    sent = lines(line(), line(), "no object", line(status="404"), line(uri="?x"), "", "  ")
    found = {row.drop_reason: row.lines for row in drop_reasons(sent).collect()}
    assert found == {"kept": 2, "not_a_request": 1, "status": 1, "empty_path": 1}


def test_unstorable_requests_carry_no_address(lines):
    found = unstorable(judge(parse_lines(lines(line(), line(uri="?x"), line(status="404")))))
    assert "remote_ip" not in found.columns
    assert [row.drop_reason for row in found.collect()] == ["empty_path"]


def test_consumed_per_file(spark, tmp_path):
    (tmp_path / "b.log").write_bytes(b"one\r\n\ntwo\n")
    (tmp_path / "a.log").write_bytes("é\n".encode())
    found = consumed_per_file(read_lines(spark, str(tmp_path))).collect()
    assert [(row.file.rsplit("/", 1)[1], row.lines, row.bytes) for row in found] == [("a.log", 1, 3), ("b.log", 3, 10)]
