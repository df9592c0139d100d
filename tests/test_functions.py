import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglens.functions import glob as G
from loglens.functions import paths as PH
from loglens.functions import regex as rx
from loglens.functions import timeparse as tp


def _eval(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_severity_vectors(spark):
    hits = ["an Err in unit 7", "Critical heat", "SEVERE:", "see traceback", "PANIC!"]
    got = _eval(spark, hits + ["errors terror", "no news"], lambda c: rx.match(c, rx.severity_pattern("errors")))
    assert got == [True] * 5 + [False] * 2
    assert rx.severity_pattern("Warnings") == r"(?i)\b(warn|warning)\b"
    assert rx.severity_pattern("timeout") == "timeout"


def test_levels(spark):
    lines = ["trace of an exception", "err 5", "Warning: info", "info", "[Trace]", "errand"]
    assert _eval(spark, lines, rx.level) == ["fatal", "error", "warn", "info", "debug", "none"]


def test_ascii_word_boundary_and_case_folding(spark):
    # RE2 \b is ASCII: 'é' is not a word character, so 'éerror' has a boundary before 'error'
    got = _eval(spark, ["éerror", "xerror", "ÉCOLE"], lambda c: rx.match(c, r"\berror"))
    assert got == [True, False, False]
    got = _eval(spark, ["ÉCOLE", "école"], lambda c: rx.match(c, "école", ignore_case=True))
    assert got == [True, True]


def test_cr_is_not_line_end(spark):
    got = _eval(spark, ["foo\r", "foo"], lambda c: rx.match(c, "foo$"))
    assert got == [False, True]


def test_posix_class_and_named_group(spark):
    got = _eval(spark, ["abc", "123"], lambda c: rx.match(c, "^[[:alpha:]]+$"))
    assert got == [True, False]
    got = _eval(spark, ["id=42"], lambda c: rx.match(c, r"id=(?P<n>\d+)"))
    assert got == [True]


@pytest.mark.parametrize("pattern, text, want", [
    (r"a\sb", "a\x0bb", False), (r"a\sb", "a\fb", True), (r"a[\s_]b", "a\x0bb", False), (r"a[\S]b", "a\x0bb", True), (r"^\S$", "\t", False),
    (r"\p{Greek}+", "αβ", True), (r"\p{Greek}", "ab", False), (r"^\pL+\z", "é", True), (r"\P{Greek}", "α", False), (r"\p{^Greek}", "α", False),
    (r"x{,3}", "x{,3}", True), (r"x{,3}", "xx", False), (r"x(?i)err", "xERR", True), (r"[[:space:]]", "\x0b", True), (r"(?s-i:a.b)", "a\nb", True),
])
def test_dialect(spark, pattern, text, want):
    assert _eval(spark, [text], lambda c: rx.match(c, pattern)) == [want]


@pytest.mark.parametrize("bad", ["(?x)a b", "(?ix:a)", "(?d)a", r"(?=x)", r"(?<!a)b", r"(a)\1", "a*+", "(?>a)", r"\Z", "(?U)a"])
def test_rejects_non_re2(bad):
    with pytest.raises(rx.UnsupportedPattern):
        rx.to_java(bad)


GLOB_CASES = [
    ("/data/?/out-*", "/data/7/out-2031", True),
    ("/data/?/out-*", "/data/77/out-1", False),
    ("/data/**", "/data/x/y/z", True),
    ("/data/**/tail", "/data/tail", True),
    ("/data/**/tail", "/data/a/b/tail", True),
    ("/data/**/tail", "/data/a/btail", False),
    ("/data/*", "/data/a/b", False),
    ("/d+(x)/a.b", "/d+(x)/a.b", True),
    ("/d+(x)/a.b", "/dd(x)/a.b", False),
    ("/d/a.b", "/d/axb", False),
]


@pytest.mark.parametrize("pattern,path,want", GLOB_CASES)
def test_glob_table(spark, pattern, path, want):
    assert _eval(spark, [path], lambda c: G.glob_match(c, pattern)) == [want]


def test_glob_brackets_literal(spark):
    assert _eval(spark, ["/a/[x].log", "/a/x.log"], lambda c: G.glob_match(c, "/a/[x].log")) == [True, False]


def test_literal_root():
    assert G.literal_root("/var/log/*.log") == "/var/log"
    assert G.literal_root("/var/log/app.log") == "/var/log/app.log"
    assert G.literal_root("*.log") == "."
    assert G.literal_root("/*.log") == "/"
    with pytest.raises(ValueError):
        G.check_root("/**/x.log")


def test_likely_and_rotated(spark):
    paths = ["/x/app.log", "/x/applog.conf", "/x/syslog.1", "/x/app.log.1", "/x/app.log.2.gz", "/x/access_log",
             "/x/app.log.log.1", "/x/worker.log-2026", "/x/current", "/x/mylog", "/x/a.TXT"]
    assert _eval(spark, paths, PH.is_log) == [True, False, False, True, True, True, True, False, True, True, True]
    assert _eval(spark, paths, PH.is_rotated) == [False, False, False, True, True, False, True, True, False, False, False]


TIME_VECTORS = [
    ("2024-01-02T03:04:05Z x", "2024-01-02 03:04:05.000000"),
    ("2024-01-02T3:04:05.123456+02:00 y", "2024-01-02 01:04:05.123456"),
    ("2024-01-02T03:04:05 nozone", None),
    ("2024-01-02 03:04:05.123 a", "2024-01-02 03:04:05.123000"),
    ("2024-01-02 3:04:05,1234 b", "2024-01-02 03:04:05.123000"),
    ("2024-01-02  03:04:05 c", None),
    ("2024-02-30 03:04:05 d", None),
    ("2024/01/02 03:04:05 e", "2024-01-02 03:04:05.000000"),
    ("01/02/2024 03:04:05 f", "2024-01-02 03:04:05.000000"),
    ("Jan 02 03:04:05 g", "2025-01-02 03:04:05.000000"),
    ("jan 02 3:04:05 h", "2025-01-02 03:04:05.000000"),
    ("Jan 02 3:04:05x", None),
    ("Aug  3 10:00:00 z", None),
    ("[2024-01-02 03:04:05] q", None),
    ('{"ts": "2024-01-02 03:04:05.5", "a": 1}', "2024-01-02 03:04:05.000000"),
    ('{"time": 5, "ts":"2024-05-05T01:02:03Z"}', "2024-05-05 01:02:03.000000"),
    ('{"timestamp": "bad", "@timestamp": "2024-05-05 01:02:03"}', "2024-05-05 01:02:03.000000"),
    ("short", None),
]


def test_time_layouts(spark):
    got = _eval(spark, [v for v, _ in TIME_VECTORS],
                lambda c: F.date_format(tp.line_time(c, 2025), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert got == [w for _, w in TIME_VECTORS]


def test_resolve_since():
    now = dt.datetime(2026, 8, 13, 10, 0, 0)
    assert tp.resolve_since("1d", now) == now - dt.timedelta(hours=24)
    assert tp.resolve_since("1.5w", now) == now - dt.timedelta(days=10.5)
    assert tp.resolve_since("30m", now) == now - dt.timedelta(minutes=30)
    assert tp.resolve_since("1h30m", now) == now - dt.timedelta(minutes=90)
    assert tp.resolve_since("today", now) == dt.datetime(2026, 8, 13)
    assert tp.resolve_since("2026-08-01", now) == dt.datetime(2026, 8, 1)
    assert tp.resolve_since("2026-08-01 05:06:07", now) == dt.datetime(2026, 8, 1, 5, 6, 7)
    assert tp.resolve_since("2026-08-01T05:06:07+02:00", now) == dt.datetime(2026, 8, 1, 3, 6, 7)
    assert tp.resolve_since("", now) is None
    with pytest.raises(ValueError):
        tp.resolve_since("yesterday-ish", now)


@pytest.mark.parametrize("pattern", [r"\bfoo\b", r"\ba?b", r"\b(x|y)*z", r"o\b", r"\b(ab|c)\b", r"\d\b", r"\B", r"x\b\.",
                                     r"(?i)\b(error|err)\b"])
def test_word_boundary_agrees_with_re2_style(spark, pattern):
    """The translated boundary equals an ASCII word boundary (checked with
    Python's ``re`` in ASCII mode, which defines \\b the same way)."""
    import re
    texts = ["foo", "a foo b", "xfoo", "foox", "b", "ab", "zz", "x z", "xyz", "o.", "abc c", "9", "x.",
             "ERROR", "errors", "é error", "a.", "a.b"]
    want = [re.search(pattern, t, re.ASCII) is not None for t in texts]
    assert _eval(spark, texts, lambda c: rx.match(c, pattern)) == want
