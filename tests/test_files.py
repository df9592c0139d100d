from pyspark.sql import functions as F

from loglens.operators import files as FL
from loglens.operators import inventory as INV


def _files(spark, paths, mtime="2024-01-01 00:00:00"):
    return spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, size long").withColumn(
        "mtime", F.lit(mtime).cast("timestamp"))


def test_group_files_without_history(spark):
    f = _files(spark, ["/d/api/app.log", "/d/api/error.log", "/d/api/app.log.1"])
    got = sorted(r["path"] for r in FL.resolve_groups(f, {"api": ["/d/api/*.log"]}).filter(F.col("name") == "api").collect())
    assert got == ["/d/api/app.log", "/d/api/error.log"]


def test_explicit_rotated_file_is_kept(spark):
    f = _files(spark, ["/d/api/app.log.1"])
    assert [r["path"] for r in FL.resolve_groups(f, {"x": ["/d/api/app.log.1"]}).collect()] == ["/d/api/app.log.1"]


def test_rotated_siblings(spark):
    f = _files(spark, ["/d/app.log", "/d/app.log.1", "/d/app.log.2.gz", "/d/other.log", "/e/app.log.1"])
    sel = f.filter(F.col("path") == "/d/app.log")
    got = sorted(r["path"] for r in FL.rotated_siblings(sel, f).collect())
    assert got == ["/d/app.log", "/d/app.log.1", "/d/app.log.2.gz"]


def test_exclude_directory_prunes_subtree_but_not_root(spark):
    f = _files(spark, ["/var/log/journal/a/b.log", "/var/log/app.log", "/var/log/x/app.log"])
    out = f.filter(~FL.excluded(F.col("path"), ["/var/log/x", "/var/log/journal/**"], "/var/log"))
    assert [r["path"] for r in out.collect()] == ["/var/log/app.log"]
    # a pattern equal to the root prunes nothing by itself
    out2 = f.filter(~FL.excluded(F.col("path"), ["/var/log"], "/var/log"))
    assert out2.count() == 3


def test_distribution_presets(spark):
    assert "/var/log/syslog*" in FL.family_patterns("debian")
    assert "/var/log/secure*" not in FL.family_patterns("debian")
    assert "/var/log/secure*" in FL.family_patterns("rhel")
    assert "/var/log/syslog*" not in FL.family_patterns("rhel")
    assert FL.family_patterns("other") == ["/var/log/journal/**", "/var/log/audit/**"]
    assert "/var/log/emerge.log*" not in FL.family_patterns("unknown")
    hosts = spark.createDataFrame([("u", "linux", "ubuntu debian"), ("c", "linux", "centos rhel fedora")],
                                  "host string, os string, ids string")
    files = spark.createDataFrame([(h, p) for h in "uc" for p in ["/var/log/syslog", "/var/log/secure", "/var/log/app.log"]],
                                  "host string, path string")
    got = sorted((r["host"], r["path"]) for r in FL.exclude_system_logs(files, hosts, "/var/log").collect())
    assert got == [("c", "/var/log/app.log"), ("c", "/var/log/syslog"), ("u", "/var/log/app.log"), ("u", "/var/log/secure")]
    fams = {r["host"]: r["family"] for r in FL.host_family(hosts).collect()}
    assert fams == {"u": "debian", "c": "rhel"}


def test_find_source_order_of_rules(spark):
    f = _files(spark, ["/srv/api/x.log", "/srv/x/api.log", "/srv/myapi/x.log", "/srv/x/myapi.log", "/api/z/q.log",
                       "/x/rapid/z/q.log", "/api/myapi/q.log"])
    got = {r["path"]: r["score"] for r in FL.find_source(f, "api").collect()}
    # "directory contains" comes before "path segment" in the rule order
    assert got == {"/srv/api/x.log": 100, "/srv/x/api.log": 95, "/srv/myapi/x.log": 80, "/srv/x/myapi.log": 70,
                   "/api/z/q.log": 90, "/x/rapid/z/q.log": 40, "/api/myapi/q.log": 80}


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "1", 10), ("b", "2", 10), ("c", "3", 10), ("d", "4", 10)],
                                "path string, file_id string, size long")
    new = spark.createDataFrame([("a", "1", 12), ("b", "9", 10), ("c", "3", 5), ("e", "5", 1)],
                                "path string, file_id string, size long")
    got = {r["path"]: r["status"] for r in FL.diff_snapshots(old, new).collect()}
    assert got == {"a": "appended", "b": "rotated", "c": "truncated", "d": "removed", "e": "new"}
    assert [r["path"] for r in FL.removed_sources(old, new).collect()] == ["d"]


def test_split_targets_and_union(spark):
    assert FL.split_targets(["a.log,b.log", " c.log ", ","]) == ["a.log", "b.log", "c.log"]
    a = spark.createDataFrame([("x",), ("y",), ("",)], "path string")
    b = spark.createDataFrame([("y",), ("z",)], "path string")
    assert sorted(r["path"] for r in FL.union_sources(a, b).collect()) == ["x", "y", "z"]


def test_process_and_port_selectors(spark):
    fds = spark.createDataFrame([
        ("h", 10, "nginx", "nginx\u0000-g", "/var/log/nginx/access.log (deleted)"),
        ("h", 10, "nginx", "nginx", "/dev/null"),
        ("h", 11, "python3", "python3 app.py --name API", "/srv/api.log"),
        ("h", 12, "python3", "python3 other.py", "relative.log"),
    ], "host string, pid long, comm string, cmdline string, fd_path string")
    got = sorted(r["path"] for r in INV.logs_of_process(fds, "api").collect())
    assert got == ["/srv/api.log"]
    assert [r["path"] for r in INV.logs_of_process(fds, "10").collect()] == ["/var/log/nginx/access.log"]
    lst = spark.createDataFrame([("h", 80, 11), ("h", 80, 12)], "host string, port long, pid long")
    assert [r["pid"] for r in INV.logs_of_port(lst, fds, 80).collect()] == [11]


def test_rotated_siblings_name_rules(spark):
    f = _files(spark, ["/d/app.log", "/d/app.log-2024", "/d/app.log.1", "/d/app.logs", "/d/app.log2",
                       "/d/xapp.log.1", "/e/app.log.3"])
    got = sorted(r["path"] for r in FL.rotated_siblings(f.filter(F.col("path") == "/d/app.log"), f).collect())
    # app.log-2024 is a sibling by name but not a likely log, so it is dropped like in the original
    assert got == ["/d/app.log", "/d/app.log.1"]


def test_resolve_targets(spark):
    from loglens.operators.targets import kind_of, resolve_targets

    groups = {"shop": ["/srv/shop/*.log"]}
    kinds = {"shop": "group", "@java": "process", ":80": "port", "/srv/x": "path", "a*": "path", "name": "name", "@": "name", ":x": "name"}
    assert {t: kind_of(t, groups) for t in kinds} == kinds
    names = ["/srv/shop/a.log", "/srv/shop/a.log.1", "/srv/pay/pay.log", "/srv/pay/notes.md", "/srv/old/x.log"]
    files = spark.createDataFrame([(p, i) for i, p in enumerate(names)], "path string, i int").withColumn("mtime", F.timestamp_seconds("i")).withColumn("size", F.lit(1))
    fds = spark.createDataFrame([("h", 7, "java", "java -jar x", "/srv/old/x.log")], "host string, pid long, comm string, cmdline string, fd_path string")

    def got(targets, **options):
        return {r.path for r in resolve_targets(files, targets, ["/srv"], groups, fds, **options).collect()}

    assert got(["shop"]) == {"/srv/shop/a.log", "/srv/shop/a.log.1"}
    assert got(["shop"], history=False) == {"/srv/shop/a.log"}
    assert got(["@java, pay"]) == {"/srv/old/x.log", "/srv/pay/pay.log"}
    assert got([], max_files=2, history=False) == {"/srv/old/x.log", "/srv/pay/pay.log"}
    assert got(["/srv/pay"], excludes=["/srv/pay/**"]) == set()


def test_a_table_of_patterns_selects_as_the_mapping_does(spark):
    """The look-up by literal root gives what the predicates of ``resolve_groups`` give."""
    paths = [f"/srv/{a}/{b}" for a in ("api", "web/x", "w.b", "api[1]") for b in ("app.log", "app.log.1", "logs/e.log", "logs/deep/f.out", "notes.md", "a(b).log")]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    groups = {"one": ["/srv/api/*.log", "/srv/w.b/app.log.1"], "two": ["/srv/**/logs/*", "/srv/web"], "three": ["/srv/ap?/**", "/srv/*/a(b).log"], "four": ["/srv//web/x/", "**/app.log", "/srv/api[1]/app.log"], "none": ["/opt/*.log"]}
    table = FL.groups_table(spark, groups)
    excludes = ["/srv/web/x/logs/**"]
    for history in (False, True):
        want = {tuple(r) for r in FL.resolve_groups(files, groups, excludes, history).collect()}
        got = FL.resolve_group_table(files, table, spark.createDataFrame([(e,) for e in excludes], "pattern string"), history)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_positions_in_reading_order(spark):
    files = spark.createDataFrame([(f"/f{i % 50}", i % 7) for i in range(50)], "path string, m int").withColumn("mtime", F.timestamp_seconds("m"))
    want = [r["path"] for r in FL.history_order(files).collect()]
    assert [r["path"] for r in FL.history_positions(files, 5).orderBy("pos").collect()] == want


def test_targets_to_blocks(spark, tmp_path):
    """From words to matches: a group, a path and a name; history first unless only current files count."""
    import os

    from loglens.config import LogQuery
    from loglens.plans.search import search_targets

    for i, (name, text) in enumerate((("api/app.log.1", "ERROR old\n"), ("api/app.log", "ok\nERROR new\n"), ("web/error.log", "ERROR w\n"), ("db/main.log", "ERROR d\n"), ("db/skip.txt.bak", "ERROR no\n"))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1_767_225_600 + i, 1_767_225_600 + i))
    go = lambda targets, **k: [(os.path.relpath(r["path"], tmp_path), r["lines"]) for r in search_targets(spark, targets, [str(tmp_path)], LogQuery(pattern="ERROR"), "2026-01-01 12:00:00", groups={"it's": [f"{tmp_path}/api/*.log"]}, **k).collect()]
    assert go(["it's"]) == [("api/app.log.1", ["ERROR old"]), ("api/app.log", ["ERROR new"])]
    assert go(["it's", "main"], current=True) == [("api/app.log", ["ERROR new"]), ("db/main.log", ["ERROR d"])]
    assert go([f"{tmp_path}/web/error.log,{tmp_path}/nothing/*"]) == [("web/error.log", ["ERROR w"])]
    assert go(["nowhere-at-all"]) == []
