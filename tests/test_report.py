import datetime as dt

from pyspark.sql import functions as F

from loglens.operators import report as R

NOW = dt.datetime(2026, 8, 13, 10, 0, 0)


def _events(spark, rows):
    return spark.createDataFrame([(s, l, (NOW + dt.timedelta(seconds=o)).strftime("%Y-%m-%d %H:%M:%S")) for s, l, o in rows],
                                 "source string, line string, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_groups_count_and_span(spark):
    ev = _events(spark, [("/x.log", "disk full", -40), ("/x.log", "disk full", -3), ("/y.log", "disk full", -9), ("/x.log", "disk full", -20)])
    groups = {(r["source"], r["line"]): (r["count"], r["first"], r["last"]) for r in R.top_alerts(R.alert_groups(ev, "at")).collect()}
    ago = lambda s: NOW - dt.timedelta(seconds=s)
    assert groups == {("/x.log", "disk full"): (3, ago(40), ago(3)), ("/y.log", "disk full"): (1, ago(9), ago(9))}


def test_trailing_minute_has_both_ends(spark):
    ev = _events(spark, [("/x", str(s), s) for s in (-3600, -61, -60, -59, 0, 1)])
    r = R.trailing_rate(ev, NOW).first()
    assert (r["rate"], r["rate_capped"], r["rate_label"]) == (3, False, "3")


def test_large_rate_is_exact_and_labelled(spark):
    ev = spark.range(100_005).select(F.lit(NOW).cast("timestamp").alias("at"))
    r = R.trailing_rate(ev, NOW).first()
    assert (r["rate"], r["rate_capped"], r["rate_label"]) == (100_005, True, "100000+")


def test_latest_groups_stay(spark):
    ev = _events(spark, [("/x.log", f"id {i % 230}", i) for i in range(460)])
    kept = R.top_alerts(R.alert_groups(ev, "at")).collect()
    assert {r["line"] for r in kept} == {f"id {i}" for i in range(30, 230)} and {r["count"] for r in kept} == {2}


def test_rate_series(spark):
    ev = _events(spark, [("/a", "x", 0), ("/a", "x", 30), ("/a", "x", 61), ("/a", "x", 61)])
    got = {r["second"]: r["rate"] for r in R.rate_series(ev).collect()}
    assert got == {NOW: 1, NOW + dt.timedelta(seconds=30): 2, NOW + dt.timedelta(seconds=61): 3}


def test_watch_header_counts_sources_without_alerts(spark):
    ev = _events(spark, [("/a", "ERROR x", -1), ("/a", "ERROR x", -2)])
    files = spark.createDataFrame([("/a",), ("/b",)], "path string")
    h = R.watch_header(R.alert_groups(ev, "at"), R.trailing_rate(ev, NOW), files).first()
    assert (h["alert_groups"], h["rate"], h["sources"]) == (1, 2, 2)


def test_json_blocks_escape_and_suffix(spark):
    rows = spark.createDataFrame([("/p", 0, 1, "a <b> & c", True, False), ("/p", 2, 0, "--", False, True),
                                  ("/p", 2, 1, "d", False, False)],
                                 "path string, line_no long, sub int, line string, is_match boolean, is_gap boolean")
    j = R.to_json_blocks(R.blocks(rows, "2026-08-13 10:00:00")).first()["json"]
    assert j == ('{"path":"/p","time":"2026-08-13T10:00:00Z","suffix":"1 matches",'
                 '"lines":["a \\u003cb\\u003e \\u0026 c","--","d"]}')
    j2 = R.to_json_blocks(R.blocks(rows, "2026-08-13 10:00:00", with_counts=False)).first()["json"]
    assert '"suffix"' not in j2
    parts = R.blocks(rows, "2026-08-13 10:00:00", span=2).orderBy("part").collect()
    assert [p["lines"] for p in parts] == [["a <b> & c"], ["--", "d"]]


def test_write_json_blocks(spark, tmp_path):
    rows = spark.createDataFrame([("/p", 0, 1, "x", True, False)],
                                 "path string, line_no long, sub int, line string, is_match boolean, is_gap boolean")
    out = str(tmp_path / "json")
    R.write_json_blocks(R.blocks(rows, "2026-08-13 10:00:00"), out)
    got = [r["value"] for r in spark.read.text(out).collect()]
    assert got == ['{"path":"/p","time":"2026-08-13T10:00:00Z","suffix":"1 matches","lines":["x"]}']


def test_rate_label_and_default_since():
    from loglens.config import LogQuery
    q = LogQuery(pattern="ERROR").with_defaults(NOW)
    assert q.since == NOW - dt.timedelta(hours=24)
    assert LogQuery().with_defaults(NOW).since is None
    assert LogQuery(pattern="x", since="2020-01-01").with_defaults(NOW).since == "2020-01-01"


def test_json_escapes_line_separators(spark):
    rows = spark.createDataFrame([("/p", 0, 1, "a b", True, False)],
                                 "path string, line_no long, sub int, line string, is_match boolean, is_gap boolean")
    j = R.to_json_blocks(R.blocks(rows, "2026-08-13 10:00:00")).first()["json"]
    assert '"lines":["a\\u2028b"]' in j
