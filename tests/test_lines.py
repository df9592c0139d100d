import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brute import output
from conftest import lines_df
from loglens.config import LogQuery
from loglens.operators import lines as L
from loglens.operators.ordered import line_bucket, ordinal, previous_row, quantile_bucket
from loglens.plans.search import snapshot


def _rows(df, cols=("path", "line_no", "sub", "line")):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_context_keeps_the_place_of_noise(spark):
    df = lines_df(spark, {"/v.log": ["start", "ping", "FATAL disk", "retry", "done"]})
    q = LogQuery(pattern="FATAL", before=1, after=1, ignore=("ping",))
    for plan in ("join", "window", "bucket"):
        out = L.select_lines(df, q, plan=plan)
        assert [r["line"] for r in out.orderBy("line_no", "sub").collect()] == ["FATAL disk", "retry"]


def test_last_lines(spark):
    df = lines_df(spark, {"/w.log": list("pqrst")})
    assert [r["line"] for r in L.tail_lines(df, 3).orderBy("line_no").collect()] == ["r", "s", "t"]


def _random_files(seed, n_files=6, max_len=60):
    rnd = random.Random(seed)
    words = ["ok", "ERROR x", "noise", "ERROR y", "ok", "warn", "ok"]
    files = {}
    for f in range(n_files):
        n = rnd.randint(0, max_len)
        files[f"/r/f{f}.log"] = [rnd.choice(words) for _ in range(n)]
    return files


PLANS = ("auto", "select", "join", "bucket", "window")


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("width", [2, 7, 1000])
def test_search_matches_brute_force(spark, seed, width):
    """The rows are those of the whole file for every plan and bucket width."""
    files = _random_files(seed)
    rnd = random.Random(seed * 7)
    before, after = rnd.randint(0, 3), rnd.randint(0, 9)
    df = lines_df(spark, files)
    for runs in (False, True):
        q = LogQuery(pattern="ERROR", before=before, after=after, ignore=("noise",), dedup=runs)
        want = sorted((p, *row) for p, ls in files.items() for row in output(ls, "ERROR", before, after, ("noise",), runs))
        for plan in PLANS:
            assert _rows(L.select_lines(df, q, plan=plan, bucket_width=width)) == want, (before, after, runs, plan)


@pytest.mark.parametrize("width", [1, 3, 50])
def test_runs_go_over_bucket_edges(spark, width):
    files = {"/one.log": ["x"] * 40, "/two.log": ["a", "x", "a", "a", "x", "x", "x"] * 3, **_random_files(4)}
    df = lines_df(spark, files)
    got = _rows(L.select_lines(df, LogQuery(dedup=True), bucket_width=width))
    assert got == sorted((p, *row) for p, ls in files.items() for row in output(ls, None, runs=True))


def test_halo_wider_than_a_bucket(spark):
    df = lines_df(spark, {"/h.log": ["HIT", *"abcdefghijklmnop"]})
    q = LogQuery(pattern="HIT", after=12)
    for plan in PLANS:
        assert L.select_lines(df, q, plan=plan, bucket_width=4).count() == 13


def test_match_at_a_bucket_edge(spark):
    """Matches on both sides of an edge, one line apart, keep their marker."""
    df = lines_df(spark, {"/e.log": ["ok"] * 7 + ["HIT", "ok", "HIT"] + ["ok"] * 6})
    for plan in PLANS:
        rows = _rows(L.select_lines(df, LogQuery(pattern="HIT"), plan=plan, bucket_width=8))
        assert [(r[1], r[2]) for r in rows] == [(7, 1), (9, 0), (9, 1)]


@pytest.mark.parametrize("width", [2, 64])
def test_snapshot_at_bucket_edges(spark, width):
    files = _random_files(6, n_files=4)
    df = lines_df(spark, files)
    got = _rows(snapshot(df, 5, LogQuery(pattern="ERROR", before=1, dedup=True), bucket_width=width))
    want = []
    for p, ls in files.items():
        skip = max(0, len(ls) - 20)
        want += [(p, n + skip, sub, text) for n, sub, text in output(ls[skip:], "ERROR", 1, 0, runs=True)]
    assert got == sorted(want)


def test_drop_repeats_and_gaps_small_buckets(spark):
    files = _random_files(9, n_files=3, max_len=40)
    df = lines_df(spark, files)
    got = sorted((r["path"], r["line_no"]) for r in L.drop_repeats(df, bucket_width=4).collect())
    want = sorted((p, i) for p, ls in files.items() for i, l in enumerate(ls) if i == 0 or ls[i - 1] != l)
    assert got == want


def test_ordinal_matches_row_number(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice("abc"), rnd.randint(0, 50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x long, id long")
    b = quantile_bucket(df, F.col("x"), 8)
    got = ordinal(df, ["k"], [F.col("x"), F.col("id")], b, "o")
    w = Window.partitionBy("k").orderBy("x", "id")
    want = df.withColumn("o", F.row_number().over(w) - 1)
    assert sorted(map(tuple, got.select("k", "id", "o").collect())) == sorted(map(tuple, want.select("k", "id", "o").collect()))


def test_previous_row_across_buckets(spark):
    df = spark.createDataFrame([("p", i, f"v{i}") for i in [0, 1, 5, 9, 10, 30]], "path string, line_no long, line string")
    out = previous_row(df, ["path"], "line_no", ["line"], line_bucket("line_no", 4))
    got = {r["line_no"]: (r["prev_line_no"], r["prev_line"]) for r in out.collect()}
    assert got == {0: (None, None), 1: (0, "v0"), 5: (1, "v1"), 9: (5, "v5"), 10: (9, "v9"), 30: (10, "v10")}


def test_fair_batches_and_cap(spark):
    df = lines_df(spark, {"/a": [str(i) for i in range(25)], "/b": [str(i) for i in range(3)]})
    fb = {(r["path"], r["line_no"]): r["round"] for r in L.fair_batches(df, 10, bucket_width=6).collect()}
    assert fb[("/a", 0)] == 0 and fb[("/a", 9)] == 0 and fb[("/a", 10)] == 1 and fb[("/a", 24)] == 2 and fb[("/b", 2)] == 0
    cap = L.cap_pending(df, 20).collect()
    assert sorted(r["line_no"] for r in cap if r["path"] == "/a") == list(range(5, 25))
    assert {r["path"]: r["dropped"] for r in cap} == {"/a": 5, "/b": 0}


def test_snapshot_no_pattern_takes_last_n(spark):
    df = lines_df(spark, {"/s": ["a", "a", "b", "c", "c", "c", "d"]})
    rows = snapshot(df, 3, LogQuery(dedup=True))
    assert [r["line"] for r in rows.orderBy("line_no").collect()] == ["c  × 2", "d"]


def test_since_uses_line_time_then_mtime(spark):
    df = lines_df(spark, {"/w": ["2026-08-13 09:59:59 ERROR old", "2026-08-13 10:00:01 ERROR current", "no time"]},
                  mtime="2026-08-13 10:30:00")
    q = LogQuery(pattern="ERROR", since="2026-08-13 10:00:00")
    assert [r["line"] for r in L.select_lines(df, q).collect()] == ["2026-08-13 10:00:01 ERROR current"]
    q2 = LogQuery(since="2026-08-13 10:00:00")
    assert sorted(r["line"] for r in L.select_lines(df, q2).collect()) == ["2026-08-13 10:00:01 ERROR current", "no time"]
