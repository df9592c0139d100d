import gzip
import os
import tempfile

from pyspark.sql import functions as F

from loglens.sources.text import first_bytes, last_bytes, read_lines, scan, with_line_no


def _dir():
    return tempfile.mkdtemp(prefix="loglens-src-")


def _write(d, name, data: bytes):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)
    return p


def _gz(d, name, data: bytes):
    p = os.path.join(d, name)
    with gzip.open(p, "wb") as f:
        f.write(data)
    return p


def _lines(df):
    return [(os.path.basename(r["path"]), r["line_no"], r["line"]) for r in df.orderBy("path", "line_no").collect()]


def test_plain_crlf_empty_and_no_trailing_newline(spark):
    d = _dir()
    _write(d, "a.log", b"one\r\ntwo\r\r\n\nlast")
    _write(d, "empty.log", b"")
    _write(d, "nl.log", b"\n")
    got = _lines(scan(spark, d))
    assert got == [("a.log", 0, "one"), ("a.log", 1, "two"), ("a.log", 2, ""), ("a.log", 3, "last"), ("nl.log", 0, "")]


def test_gzip_mixed_with_plain(spark):
    d = _dir()
    _gz(d, "app.log.1.gz", b"INFO ok\nERROR old\n")
    _gz(d, "upper.log.GZ", b"x\ny\n")
    _write(d, "app.log", b"ERROR new\n")
    got = _lines(scan(spark, d))
    assert ("app.log.1.gz", 1, "ERROR old") in got
    assert ("app.log", 0, "ERROR new") in got
    assert len([g for g in got if g[0] == "app.log.1.gz"]) == 2
    assert [g[2] for g in got if g[0] == "upper.log.GZ"] == ["x", "y"]


def test_gzip_read_window_cuts_long_line(spark):
    d = _dir()
    _gz(d, "large.log.gz", b"x" * 4096)
    out = first_bytes(scan(spark, d), 128).collect()
    assert len(out) == 1 and len(out[0]["line"]) == 128


def test_last_bytes_window(spark):
    d = _dir()
    _write(d, "w.log", b"aaaa\nbbbb\ncccc\n")
    out = [r["line"] for r in last_bytes(scan(spark, d), 7).orderBy("line_no").collect()]
    # the last 7 bytes are "b\ncccc\n": a cut line, then a whole one
    assert out == ["b", "cccc"]


def test_scalable_ordinal_equals_simple_on_many_splits(spark):
    d = _dir()
    body = "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(20000)).encode()
    _write(d, "big.log", body)
    _write(d, "small.log", b"s0\ns1\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        raw = read_lines(spark, d)
        assert raw.rdd.getNumPartitions() > 5
        a = with_line_no(raw, "scalable").select("path", "line_no", "line")
        b = with_line_no(raw, "simple").select("path", "line_no", "line")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        bad = a.filter(F.col("path").endswith("big.log")).filter(
            F.col("line") != F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" "),
                                      F.expr("repeat('x', CAST(line_no % 37 AS INT))")))
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_path_predicate_prunes_at_scan(spark):
    d = _dir()
    _write(d, "keep.log", b"a\n")
    _write(d, "drop.txt", b"b\n")
    df = read_lines(spark, d, path_regex=r"\.log$")
    assert [r["line"] for r in df.collect()] == ["a"]


def test_catalog_from_directories(spark):
    from loglens.operators import files as FL
    from loglens.sources.catalog import list_files

    d = _dir()
    _write(d, "app.log", b"x\n")
    _write(d, "app.log.1", b"x\n")
    _write(d, "sub/worker.out", b"x\n")
    _write(d, "skip/ignored.log", b"x\n")
    _write(d, "notes.conf", b"x\n")
    files = list_files(spark, [d])
    assert "content" not in files.columns
    cat = FL.catalog(files, [d], excludes=[d + "/skip"])
    got = sorted(os.path.relpath(r["path"], d) for r in cat.collect())
    assert got == ["app.log", "sub/worker.out"]
    hist = FL.catalog(files, [d], excludes=[d + "/skip"], history=True)
    assert sorted(os.path.relpath(r["path"], d) for r in hist.collect()) == ["app.log", "app.log.1", "sub/worker.out"]


def test_search_files_end_to_end(spark):
    from loglens.config import LogQuery
    from loglens.operators.report import to_json_blocks
    from loglens.plans.search import search_files

    d = _dir()
    _write(d, "app.log", b"2024-01-01 00:00:00 INFO a\n2024-01-01 00:00:01 ERROR boom\n2024-01-01 00:00:02 INFO b\n"
                         b"2024-01-01 00:00:03 INFO c\n2024-01-01 00:00:04 INFO d\n2024-01-01 00:00:05 ERROR again\n")
    _gz(d, "app.log.1.gz", b"INFO ok\nERROR old\n")
    q = LogQuery(pattern="error", before=1, after=0, since="2023-12-31 00:00:00")
    blk = {os.path.basename(r["path"]): r for r in search_files(spark, d, q, "2024-01-02 00:00:00").collect()}
    assert blk["app.log"]["lines"] == ["2024-01-01 00:00:00 INFO a", "2024-01-01 00:00:01 ERROR boom", "--",
                                       "2024-01-01 00:00:04 INFO d", "2024-01-01 00:00:05 ERROR again"]
    assert blk["app.log"]["suffix"] == "2 matches"
    # lines without a time fall back to the file's mtime (recent here)
    assert blk["app.log.1.gz"]["lines"] == ["INFO ok", "ERROR old"]
    js = to_json_blocks(search_files(spark, d, q, "2024-01-02 00:00:00")).collect()
    assert len(js) == 2


def test_paths_are_decoded_and_join_the_listing(spark):
    from loglens.sources.catalog import list_files

    d = _dir()
    names = ["my app%1.log", "a+b.log", "é ü.log", "x%20y.log"]
    for n in names:
        _write(d, n, b"one\ntwo\n")
    lines = scan(spark, d)
    assert {os.path.basename(r.path) for r in lines.select("path").distinct().collect()} == set(names)
    assert lines.join(list_files(spark, [d]), "path").count() == 8


def test_bad_files_fail_or_are_told(spark):
    import pytest

    from loglens.sources.text import skipped_files

    d = _dir()
    _write(d, "good.log", b"x\n")
    _write(d, "bad.log.gz", b"this is no gzip")
    with pytest.raises(Exception):
        scan(spark, d).count()
    assert scan(spark, d, skip_bad_files=True).count() == 1
    assert [os.path.basename(r.path) for r in skipped_files(spark, d).collect()] == ["bad.log.gz"]
