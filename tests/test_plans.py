"""Plan-shape checks: the properties that make the operators scale."""

import os
import re
import tempfile

from pyspark.sql import functions as F

from conftest import lines_df
from loglens.config import LogQuery
from loglens.operators import files as FL
from loglens.operators import lines as L
from loglens.operators import report as R


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final(df) -> str:
    df.collect()  # AQE settles the final plan on execution
    return _plan(df)


def test_bucket_plan_shuffles_the_lines_once_for_context(spark):
    df = lines_df(spark, {"/a": ["ok", "ERROR x", "ok", "ok"], "/b": ["ERROR y"]})
    p = _plan(L.select_lines(df, LogQuery(pattern="ERROR", before=1, after=1), plan="bucket", markers=False))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1 and "Join" not in p


def test_context_sends_positions_only(spark):
    """The side that names the wanted positions carries no text."""
    df = lines_df(spark, {"/a": ["ok", "ERROR x", "ok", "ok"], "/b": ["ERROR y"]}).repartition(3)
    f = L.flag_lines(df, LogQuery(pattern="ERROR"))
    p = L.context(f, 1, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in p and re.search(r"Aggregate \[path#\d+, line_no#\d+L?\], \[path#\d+, line_no#\d+L?\]", p)


def test_lines_of_blocks_never_meet_by_path_alone(spark):
    df = lines_df(spark, {"/a": ["ok", "ERROR x", "ok", "ok"], "/b": ["ERROR y"]})
    p = _plan(R.blocks(L.select_lines(df, LogQuery(pattern="ERROR")), "2026-01-01 00:00:00"))
    for at in re.finditer(r"Exchange hashpartitioning\(path#\d+, \d+\)", p):
        below = p[at.end() :].split("\n")[1]
        assert "lines" not in below and "_l#" not in below


def test_tail_uses_partial_window_group_limit(spark):
    df = lines_df(spark, {"/a": [str(i) for i in range(10)]})
    p = _final(L.tail_lines(df, 3))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_top_k_is_take_ordered(spark):
    df = spark.createDataFrame([("/a", "x", 1), ("/b", "y", 2)], "source string, line string, at long").withColumn(
        "observed_at", F.timestamp_seconds("at"))
    p = _plan(R.top_alerts(R.alert_groups(df)))
    assert "TakeOrderedAndProject" in p


def test_group_resolution_has_no_join(spark):
    f = spark.createDataFrame([("/srv/api/app.log",)], "path string")
    p = _plan(FL.resolve_groups(f, {"api": ["/srv/api/*.log"]}))
    assert "Join" not in p and "NestedLoop" not in p


def test_siblings_join_on_dir_and_base(spark):
    f = spark.createDataFrame([("/d/app.log",), ("/d/app.log.1",)], "path string")
    p = _plan(FL.rotated_siblings(f.filter(F.col("path") == "/d/app.log"), f))
    assert "NestedLoop" not in p
    assert re.search(r"Join .*\[dir#\d+, base#\d+\]", p) or re.search(r"LeftSemi", p)


def test_text_scan_prunes_files_by_path(spark):
    from loglens.sources.text import read_lines

    d = tempfile.mkdtemp(prefix="loglens-plan-")
    for name in ("a.log", "b.txt", "c.txt"):
        with open(os.path.join(d, name), "w") as fh:
            fh.write("x\n")
    df = read_lines(spark, d, path_regex=r"\.log$")
    assert df.count() == 1
    assert "file_path" in _plan(df)


def test_plain_search_filters_before_its_shuffle(spark):
    df = lines_df(spark, {"/a": ["ok", "ERROR x", "ok", "ERROR y"]})
    p = _plan(L.select_lines(df, LogQuery(pattern="ERROR")))
    ex = p.index("Exchange hashpartitioning(path")
    flt = p.index("Filter", ex)  # the filter is below (printed after) the exchange
    assert flt > ex and "Window" in p[:ex]


def _text_exchanges(df) -> int:
    """Exchanges of the final plan whose rows hold whole lines (the edge rows of buckets have names of their own)."""
    plan = _final(df).split("== Initial Plan ==")[0].split("\n")
    below = [plan[i + 1] for i, x in enumerate(plan) if re.search(r"[-:] Exchange hashpartitioning\(path#\d+, (bk|_b)#", x)]
    return sum(bool(re.search(r"[( ,\[]line#", x)) for x in below)


def test_selected_lines_cross_one_exchange(spark):
    """Markers, runs and blocks: everything else that is shuffled is one row a bucket."""
    df = lines_df(spark, {"/a": ["ok", "ERROR x", "ok", "ok"] * 9, "/b": ["ERROR y"] * 5}).repartition(3)
    for dedup in (False, True):
        rows = L.select_lines(df, LogQuery(pattern="ERROR", dedup=dedup), bucket_width=4)
        assert _text_exchanges(rows) == 1, dedup
        assert _text_exchanges(R.blocks(rows, "2026-01-01 00:00:00")) == 1, dedup


def test_blocks_keep_a_byte_budget(spark):
    """Long lines: every block is about the budget, its number has no gaps, the total is the source's."""
    df = lines_df(spark, {"/a": [f"{i:04d}" + "x" * 1996 for i in range(300)] + ["y" * 50_000, "end"], "/b": ["short"]})
    rows = L.select_lines(df, LogQuery(pattern="x|y|e|s"), bucket_width=64)
    got = R.blocks(rows, "2026-01-01 00:00:00", max_bytes=20_000).collect()
    by = {}
    for r in got:
        by.setdefault(r.path, {})[r.part] = r.lines
        assert sum(len(x) + 1 for x in r.lines[:-1]) <= 20_000
    assert sorted(by["/a"]) == list(range(len(by["/a"]))) and list(by["/b"]) == [0]
    assert [x for k in sorted(by["/a"]) for x in by["/a"][k]] == [r["line"] for r in df.filter("path = '/a'").orderBy("line_no").collect()]
    assert {r.suffix for r in got if r.path == "/a"} == {"302 matches"}
