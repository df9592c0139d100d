import os
import tempfile
import uuid

from pyspark.sql import functions as F

from loglens.config import LogQuery
from loglens.sources.tail import tail_stream
from loglens.streaming import follow as FW
from loglens.streaming import watch as WA


def _tmp():
    return tempfile.mkdtemp(prefix="loglens-stream-")


def _append(p, text):
    with open(p, "a", encoding="utf-8") as f:
        f.write(text)


def _mem(df, name, ckpt, mode="append"):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", ckpt).trigger(processingTime="100 milliseconds").start()


def _lines(spark, name):
    return [(os.path.basename(r["path"]), r["kind"], r["line"]) for r in
            spark.sql(f"SELECT * FROM {name} ORDER BY observed_at, path, gen, offset, "
                      "CASE WHEN kind = 'line' THEN 1 ELSE 0 END").collect()]


def test_tail_append_rotate_truncate_new_file(spark):
    d = _tmp()
    app = os.path.join(d, "app.log")
    _append(app, "l1\nl2\nl3\n")
    name = "t_" + uuid.uuid4().hex[:8]
    q = _mem(tail_stream(spark, os.path.join(d, "*.log"), startingLines=2), name, os.path.join(_tmp(), "c"))
    try:
        q.processAllAvailable()
        assert _lines(spark, name) == [("app.log", "line", "l2"), ("app.log", "line", "l3")]
        _append(app, "l4\npartial")
        q.processAllAvailable()
        got = [x[2] for x in _lines(spark, name)]
        assert got == ["l2", "l3", "l4"]  # the unfinished line waits (T5)
        _append(app, " done\r\n")
        q.processAllAvailable()
        assert [x[2] for x in _lines(spark, name)][-1] == "partial done"
        # rotation: the old file is renamed, a new one takes its name (T4)
        # (written elsewhere first: a listing between creation and writing would see an empty file)
        _append(app + ".new", "n1\nn2\nn3\n")
        os.rename(app, app + ".1")
        os.rename(app + ".new", app)
        q.processAllAvailable()
        tail = _lines(spark, name)[-3:]
        assert tail == [("app.log", "rotated", None), ("app.log", "line", "n2"), ("app.log", "line", "n3")]
        # truncation: shorter content under the same identity
        with open(app, "r+") as f:
            f.truncate(0)
        _append(app, "t1\n")
        q.processAllAvailable()
        assert _lines(spark, name)[-2:] == [("app.log", "truncated", None), ("app.log", "line", "t1")]
        # a new file is picked up with its last lines
        _append(os.path.join(d, "new.log"), "a\nb\nc\n")
        q.processAllAvailable()
        assert [x[2] for x in _lines(spark, name) if x[0] == "new.log"] == ["b", "c"]
    finally:
        q.stop()


def test_admission_limit_and_long_lines(spark):
    d = _tmp()
    p = os.path.join(d, "hot.log")
    _append(p, "")
    name = "t_" + uuid.uuid4().hex[:8]
    df = tail_stream(spark, p, startingLines=-1, maxBytesPerFile=64, lineCap=100)
    q = _mem(df, name, os.path.join(_tmp(), "c"))
    try:
        q.processAllAvailable()
        _append(p, "".join(f"line{i:03d}\n" for i in range(100)))  # 8 bytes each
        _append(p, "y" * 300 + "\n" + "end\n")
        q.processAllAvailable()
        rows = [x[2] for x in _lines(spark, name)]
        assert len(rows) == 102 and rows[:100] == [f"line{i:03d}" for i in range(100)]
        assert rows[100] == "[truncated long line] " + "y" * 100 and rows[101] == "end"
        n_batches = spark.sql(f"SELECT count(DISTINCT observed_at) FROM {name}").first()[0]
        assert n_batches >= 10  # 800+ bytes at 64 bytes per trigger
    finally:
        q.stop()


def test_restart_from_checkpoint_reads_only_new_lines(spark):
    d = _tmp()
    p = os.path.join(d, "r.log")
    _append(p, "a\nb\n")
    ckpt = os.path.join(_tmp(), "c")
    out = os.path.join(_tmp(), "out")

    def run():
        q = (tail_stream(spark, p, startingLines=-1).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(processingTime="100 milliseconds").start())
        q.processAllAvailable()
        q.stop()

    run()
    _append(p, "c\n")
    run()
    got = sorted(r["line"] for r in spark.read.parquet(out).collect())
    assert got == ["a", "b", "c"]


def _run_into(spark, path, ckpt, out, **options):
    q = (tail_stream(spark, path, **options).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(processingTime="100 milliseconds").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def _all(spark, out):
    rows = spark.read.parquet(out).orderBy("observed_at", "path", "gen", "offset").collect()
    return [r["line"] for r in rows if r["kind"] == "line"], [r["kind"] for r in rows if r["kind"] != "line"]


def test_restart_of_a_file_larger_than_a_trigger(spark):
    d, ckpt, out = _tmp(), os.path.join(_tmp(), "c"), os.path.join(_tmp(), "out")
    p = os.path.join(d, "r.log")
    want = [f"line {i}" for i in range(100)]
    _append(p, "".join(x + "\n" for x in want))
    _run_into(spark, p, ckpt, out, startingLines=-1, maxBytesPerFile=64, lineCap=40)
    _append(p, "one more\nunfinished")
    _run_into(spark, p, ckpt, out, startingLines=-1, maxBytesPerFile=64, lineCap=40)
    _append(p, " line\n")
    _run_into(spark, p, ckpt, out, startingLines=-1, maxBytesPerFile=64, lineCap=40)
    assert _all(spark, out) == ([*want, "one more", "unfinished line"], [])


def test_restart_after_rotations(spark):
    d, ckpt, out = _tmp(), os.path.join(_tmp(), "c"), os.path.join(_tmp(), "out")
    p = os.path.join(d, "r.log")
    options = {"startingLines": -1}
    _append(p, "a\nb\n")
    _run_into(spark, os.path.join(d, "*"), ckpt, out, **options)
    _append(p, "c\n")  # still unread when it is renamed
    os.rename(p, p + ".1")
    _append(p, "d\n")
    _run_into(spark, os.path.join(d, "*"), ckpt, out, **options)
    _append(p, "e\n")
    _run_into(spark, os.path.join(d, "*"), ckpt, out, **options)
    lines, markers = _all(spark, out)
    assert sorted(lines) == list("abcde") and markers == ["rotated"]


def test_renamed_files_and_directories(spark):
    d = _tmp()
    app = os.path.join(d, "sub", "app.log")
    os.makedirs(os.path.dirname(app))
    _append(app, "a\n")
    _append(os.path.join(d, "notes.md"), "no log\n")
    _append(os.path.join(d, "old.log.1"), "rotated before\n")
    name = "t_" + uuid.uuid4().hex[:8]
    q = _mem(tail_stream(spark, d, startingLines=-1), name, os.path.join(_tmp(), "c"))
    try:
        q.processAllAvailable()
        _append(app, "b\n")
        os.rename(app, app + ".1")
        _append(app, "c\n")
        q.processAllAvailable()
        assert sorted(x[2] for x in _lines(spark, name) if x[1] == "line") == ["a", "b", "c"]
    finally:
        q.stop()


def test_a_vanished_file_leaves_and_may_come_back(spark, tmp_path, monkeypatch):
    """As in the original tool it is a new file then; a file that only can't be asked about stays."""
    from loglens.sources import tail
    from loglens.sources.tail import LogTailReader

    p = tmp_path / "x.log"
    p.write_text("1\n2\n3\n")
    reader = LogTailReader({"path": str(p), "startingLines": "2", "offsetDir": str(tmp_path / "offsets")})
    first = reader.latestOffset()
    texts = lambda parts: [(r[2], r[3], r[4]) for x in parts for r in reader.read(x)]
    assert texts(reader.partitions(reader.initialOffset(), first)) == [(2, "2", "line"), (4, "3", "line")]
    assert reader.latestOffset() == first
    with monkeypatch.context() as m:
        m.setattr(tail, "_stat", lambda path: (_ for _ in ()).throw(PermissionError(path)))
        assert reader.latestOffset() == first
    p.rename(tmp_path / "away")
    gone = reader.latestOffset()
    assert gone["files"] == {} and texts(reader.partitions(first, gone)) == [(-1, None, "gone")]
    (tmp_path / "away").rename(p)
    with open(p, "a") as f:
        f.write("4\n5\n6")
    assert texts(reader.partitions(gone, reader.latestOffset())) == [(6, "4", "line"), (8, "5", "line")]


def _read_in_batches(reader, start):
    """All batches from an offset until nothing is new: their lines, and the last offset."""
    batches = []
    while True:
        end = reader.latestOffset()
        if end == start:
            return batches, end
        batches.append([r[3] for x in reader.partitions(start, end) for r in reader.read(x)])
        start = end


def test_admission_before_and_after_a_restart(tmp_path, monkeypatch):
    """Many batches at the first listing too, no file is opened to plan them, and a replay gives the same."""
    import builtins

    from loglens.sources.tail import LogTailReader

    p, want = tmp_path / "big.log", [f"line {i} " + "x" * (i % 37) for i in range(4000)]
    p.write_text("\n".join(want) + "\nunfinished")
    options = {"path": str(p), "startingLines": "-1", "maxBytesPerFile": "10000", "splitBytes": "777", "offsetDir": str(tmp_path / "offsets")}
    reader, opened = LogTailReader(options), []
    real = builtins.open
    monkeypatch.setattr(builtins, "open", lambda f, *a, **k: (opened.append(str(f)), real(f, *a, **k))[1])
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert str(p) not in opened and len(parts) == 13
    got = [r[3] for x in parts for r in reader.read(x)]
    # a replay of the planned batch, then the rest after a restart at its end
    again = LogTailReader(options)
    assert [r[3] for x in again.partitions(again.initialOffset(), end) for r in again.read(x)] == got
    restarted = LogTailReader(options)
    batches, last = _read_in_batches(restarted, end)
    assert len(batches) >= len("".join(want)) // 10000
    assert [*got, *(x for b in batches for x in b)] == want
    with real(p, "a") as f:
        f.write(" line\n")
    more, _ = _read_in_batches(restarted, last)
    assert more == [["unfinished line"]]


def test_lines_belong_to_the_range_of_their_newline(tmp_path):
    """However a file is cut: every line once, long ones by their last bytes."""
    import random

    from loglens.sources.tail import TRUNCATED_TAG, _lines_of

    rng = random.Random(4)
    lines = ["a" * rng.choice([0, 1, 5, 30, 31, 32, 200]) for _ in range(60)]
    p = tmp_path / "x.log"
    p.write_text("\n".join(lines) + "\n")
    want = [x if len(x) <= 30 else TRUNCATED_TAG + x[-30:] for x in lines]
    size = p.stat().st_size
    for _ in range(50):
        cuts = sorted({0, size, *(rng.randrange(size) for _ in range(rng.randrange(12)))})
        with open(p, "rb") as f:
            got = [x for a, b in zip(cuts, cuts[1:]) for x in _lines_of(f, a, b, 30, False)]
        assert [t for _, t in got] == want and [a for a, _ in got] == sorted(a for a, _ in got)


def test_targets_are_groups_globs_and_excludes(tmp_path):
    """Looked up anew at each listing."""
    from loglens.sources.tail import Targets

    for name in ("api/app.log", "api/app.log.1", "api/old/app.log", "web/error.log", "web/notes.md", "tmp/x.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    rel = lambda t: [os.path.relpath(x, tmp_path) for x in t.list()]
    t = Targets(f"svc,{tmp_path}/web", f'{{"svc": ["{tmp_path}/api/**/*.log*"]}}', f"{tmp_path}/**/old")
    assert rel(t) == ["api/app.log", "web/error.log"]
    (tmp_path / "api" / "late.log").write_text("y\n")
    (tmp_path / "web" / "error.log").unlink()
    assert rel(t) == ["api/app.log", "api/late.log"]
    # a directory named as an exclude isn't a target below itself, but is one as the root
    assert rel(Targets(str(tmp_path / "tmp"), "", f"{tmp_path}/tmp")) == ["tmp/x.log"]
    assert rel(Targets(str(tmp_path), "", f"{tmp_path}/tmp,{tmp_path}/api")) == []


def test_last_lines_are_found_however_far_back(tmp_path):
    from loglens.sources.tail import _last_lines_start

    p = tmp_path / "long.log"
    p.write_bytes(b"x\n" + b"y" * 6_000_000 + b"\n" + b"z\nunfinished")
    with open(p, "rb") as f:
        size = p.stat().st_size
        assert [_last_lines_start(f, size, n) for n in (0, 1, 2, 3, 4, -1)] == [size, 6_000_003, 2, 0, 0, 0]


def test_follow_filter_and_context(spark):
    d = _tmp()
    p = os.path.join(d, "c.log")
    _append(p, "x0\nhealth\nx1\nERROR a\nx2\nx3\nx4\n")
    ctx_name = "t_" + uuid.uuid4().hex[:8]
    flt_name = "t_" + uuid.uuid4().hex[:8]
    src = tail_stream(spark, p, startingLines=-1)
    q = LogQuery(pattern="ERROR", before=1, after=1, ignore=("health",))
    cq = _mem(FW.follow_context(src, q), ctx_name, os.path.join(_tmp(), "c1"))
    fq = _mem(FW.follow_filter(src, q), flt_name, os.path.join(_tmp(), "c2"))
    try:
        cq.processAllAvailable()
        fq.processAllAvailable()
        got = [r["line"] for r in spark.sql(f"SELECT * FROM {ctx_name} ORDER BY gen, offset, seq").collect()]
        assert got == ["x1", "ERROR a", "x2"]
        # the context state carries over into the next batch
        _append(p, "ERROR b\ny\nz\n")
        cq.processAllAvailable()
        fq.processAllAvailable()
        got = [r["line"] for r in spark.sql(f"SELECT * FROM {ctx_name} ORDER BY gen, offset, seq").collect()]
        assert got == ["x1", "ERROR a", "x2", "x4", "ERROR b", "y"]
        assert [r["line"] for r in spark.sql(f"SELECT * FROM {flt_name} ORDER BY offset").collect()] == ["ERROR a", "ERROR b"]
    finally:
        cq.stop()
        fq.stop()


def _plain_follow(batches, pattern, before, after, ignore):
    """Lines shown after each batch, by definition: wanted lines not shown yet, in order."""
    import re

    lines, shown, out = [], set(), []
    for batch in batches:
        lines += [x for x in batch if not any(re.search(i, x) for i in ignore)]
        hits = [p for p, x in enumerate(lines) if re.search(pattern, x)]
        wanted = [p for p in range(len(lines)) if any(h - before <= p <= h + after for h in hits)]
        late = max(shown, default=-1)
        out.append([lines[p] for p in wanted if p > late])
        shown |= set(wanted)
    return out


def test_follow_context_on_random_batches():
    import random

    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, (*value[:3], [dict(zip(("at", "gen", "offset", "line"), k)) for k in value[3]])

    rng = random.Random(7)
    for _ in range(200):
        before, after = rng.randint(0, 3), rng.randint(0, 3)
        q = LogQuery(pattern="E", before=before, after=after, ignore=("n",))
        batches = [[rng.choice(["E", "a", "b", "n", "c"]) + str(rng.random()) for _ in range(rng.randint(0, 8))] for _ in range(5)]
        step, state, offset, got = FW._make_stateful(q), State(), 0, []
        for batch in batches:
            kept = [x for x in batch if "n" not in x]
            frame = pd.DataFrame({"gen": 0, "offset": range(offset, offset + len(kept)), "line": kept, "kind": "line", "observed_at": pd.Timestamp(0),
                                  "is_match": ["E" in x for x in kept]})
            offset += len(kept)
            got.append([x for f in step(("p",), iter([frame]), state) for x in f["line"]])
        assert got == _plain_follow(batches, "E", before, after, ("n",))


def test_follow_dialect_is_the_same_with_context(spark):
    d = _tmp()
    p = os.path.join(d, "r.log")
    _append(p, "ends in err\ncode 500 é\nxERR\nplain\n")
    for pattern, want in ((r"err\z", ["ends in err"]), (r"[[:digit:]]{3}", ["code 500 é"]), (r"x(?i)err", ["xERR"]), (r"\pL\z", ["ends in err", "code 500 é", "xERR", "plain"])):
        src = tail_stream(spark, p, startingLines=-1)
        got = []
        for make in (FW.follow_filter, FW.follow_context):
            name = "t_" + uuid.uuid4().hex[:8]
            q = _mem(make(src, LogQuery(pattern=pattern)), name, os.path.join(_tmp(), "c"))
            try:
                q.processAllAvailable()
                got.append([r["line"] for r in spark.sql(f"SELECT * FROM {name} ORDER BY offset").collect()])
            finally:
                q.stop()
        assert got == [want, want], pattern


def test_follow_dedup_inside_batch(spark):
    d = _tmp()
    p = os.path.join(d, "d.log")
    _append(p, "a\na\na\nb\n")
    name = "t_" + uuid.uuid4().hex[:8]
    q = _mem(FW.follow_context(tail_stream(spark, p, startingLines=-1), LogQuery(dedup=True)), name,
             os.path.join(_tmp(), "c"))
    try:
        q.processAllAvailable()
        assert [r["line"] for r in spark.sql(f"SELECT * FROM {name} ORDER BY offset").collect()] == ["a  × 3", "b"]
    finally:
        q.stop()


def test_fair_flush(spark):
    d = _tmp()
    _append(os.path.join(d, "hot.log"), "".join(f"h{i}\n" for i in range(30)))
    _append(os.path.join(d, "cold.log"), "c0\n")
    state, out = _tmp(), _tmp()
    src = FW.follow_filter(tail_stream(spark, os.path.join(d, "*.log"), startingLines=-1), LogQuery())
    src = src.withColumn("seq", F.lit(0).cast("long"))
    q = (src.writeStream.foreachBatch(FW.fair_flush(spark, state, out, per_source=10, max_pending=20))
         .option("checkpointLocation", os.path.join(_tmp(), "c")).trigger(processingTime="100 milliseconds").start())
    try:
        q.processAllAvailable()
        res = spark.read.parquet(out)
        first = res.filter(F.col("batch_id") == res.agg(F.min("batch_id")).first()[0]).orderBy("path", "k").collect()
        hot = [r["line"] for r in first if r["path"].endswith("hot.log")]
        assert hot[0] == "⚠ skipped 10 older buffered lines (hot log)"
        assert hot[1:] == [f"h{i}" for i in range(10, 20)]
        assert [r["line"] for r in first if r["path"].endswith("cold.log")] == ["c0"]
    finally:
        q.stop()


def test_watch_sink(spark):
    d = _tmp()
    p = os.path.join(d, "api.log")
    _append(p, "ERROR timeout\nINFO fine\nERROR timeout\nERROR job failed\n")
    state = _tmp()
    q = (tail_stream(spark, os.path.join(d, "*.log"), startingLines=-1).writeStream
         .foreachBatch(WA.watch_sink(spark, state, LogQuery(pattern="errors")))
         .option("checkpointLocation", os.path.join(_tmp(), "c")).trigger(processingTime="100 milliseconds").start())
    try:
        q.processAllAvailable()
        bid = q.lastProgress["batchId"]
        alerts = {r["line"]: r["count"] for r in WA.latest(spark, state, "alerts", bid).collect()}
        assert alerts == {"ERROR timeout": 2, "ERROR job failed": 1}
        hdr = WA.latest(spark, state, "header", bid).first()
        assert (hdr["alert_groups"], hdr["rate"], hdr["sources"]) == (2, 3, 1)
        # a second batch adds to the running groups
        _append(p, "ERROR timeout\n")
        q.processAllAvailable()
        bid = q.lastProgress["batchId"]
        alerts = {r["line"]: r["count"] for r in WA.latest(spark, state, "alerts", bid).collect()}
        assert alerts == {"ERROR timeout": 3, "ERROR job failed": 1}
    finally:
        q.stop()


def test_search_then_follow_keeps_since_and_new_lines(spark):
    d = _tmp()
    p = os.path.join(d, "s.log")
    _append(p, "2020-01-01 00:00:00 ERROR old\n2030-01-01 00:00:00 ERROR future\nINFO x\n")
    name = "t_" + uuid.uuid4().hex[:8]
    q = LogQuery(pattern="ERROR", since="2025-01-01 00:00:00")
    s = _mem(FW.search_then_follow(spark, p, q), name, os.path.join(_tmp(), "c"))
    try:
        s.processAllAvailable()
        _append(p, "2031-01-01 00:00:00 ERROR newer\n")
        s.processAllAvailable()
        got = [r["line"] for r in spark.sql(f"SELECT * FROM {name} ORDER BY offset").collect()]
        assert got == ["2030-01-01 00:00:00 ERROR future", "2031-01-01 00:00:00 ERROR newer"]
    finally:
        s.stop()


def test_windowed_rate(spark):
    d = _tmp()
    p = os.path.join(d, "w.log")
    _append(p, "ERROR a\nERROR b\nINFO c\n")
    name = "t_" + uuid.uuid4().hex[:8]
    df = WA.windowed_rate(tail_stream(spark, p, startingLines=-1), LogQuery(pattern="ERROR"))
    s = _mem(df, name, os.path.join(_tmp(), "c"), mode="update")
    try:
        s.processAllAvailable()
        counts = {r["events"] for r in spark.sql(f"SELECT * FROM {name}").collect()}
        assert counts == {2}  # every sliding minute holding the batch sees both errors
        assert spark.sql(f"SELECT count(*) FROM {name}").first()[0] == 60
    finally:
        s.stop()


def test_follow_context_state_survives_restart(spark):
    """Stop and restart on the same checkpoint: the per-file state (after
    count) resumes, and no line is printed twice."""
    d = _tmp()
    p = os.path.join(d, "k.log")
    _append(p, "a\nERROR x\n")
    ckpt = os.path.join(_tmp(), "c")
    out = os.path.join(_tmp(), "out")
    q = LogQuery(pattern="ERROR", before=0, after=2)

    def run():
        s = (FW.follow_context(tail_stream(spark, p, startingLines=-1), q).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", ckpt).outputMode("append")
             .trigger(processingTime="100 milliseconds").start())
        s.processAllAvailable()
        s.stop()

    run()
    _append(p, "b\nc\nd\n")
    run()
    got = [r["line"] for r in spark.read.parquet(out).orderBy("offset").collect()]
    assert got == ["ERROR x", "b", "c"]


def test_rotation_serves_unread_tail_of_renamed_file(spark):
    d = _tmp()
    app = os.path.join(d, "app.log")
    _append(app, "a1\n")
    name = "t_" + uuid.uuid4().hex[:8]
    q = _mem(tail_stream(spark, app, startingLines=-1), name, os.path.join(_tmp(), "c"))
    try:
        q.processAllAvailable()
        # lines written just before the rotation have not been read yet
        _append(app, "a2\na3\n")
        os.rename(app, app + ".1")
        _append(app, "b1\n")
        q.processAllAvailable()
        got = [(k, l) for _, k, l in _lines(spark, name)]
        assert got == [("line", "a1"), ("line", "a2"), ("line", "a3"), ("rotated", None), ("line", "b1")]
    finally:
        q.stop()


def test_follow_and_watch_entry_points(spark):
    d = _tmp()
    p = os.path.join(d, "e.log")
    _append(p, "ERROR one\nINFO two\nERROR three\n")
    out = _tmp()
    s = FW.follow(spark, p, LogQuery(pattern="ERROR"), out, trigger="100 milliseconds", startingLines=-1)
    try:
        s.processAllAvailable()
    finally:
        s.stop()
    got = [r["line"] for r in spark.read.parquet(out).orderBy("batch_id", "k").collect()]
    assert got == ["ERROR one", "ERROR three"]
    w, state = WA.watch(spark, p, LogQuery(pattern="errors"), trigger="100 milliseconds", heartbeat=False, startingLines=-1)
    try:
        w.processAllAvailable()
        bid = w.lastProgress["batchId"]
    finally:
        w.stop()
    assert {r["line"]: r["count"] for r in WA.latest(spark, state, "alerts", bid).collect()} == {
        "ERROR one": 1, "ERROR three": 1}


STREAM = "path string, gen long, offset long, line string, kind string, observed_at timestamp"


def _batch(spark, rows):
    """Rows (path, offset, line) or (path, gen, offset, line, kind)."""
    import datetime as dt

    t = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(r[0], 0, r[1], r[2], "line") if len(r) == 3 else r for r in rows]
    return spark.createDataFrame([(*r, t) for r in rows], STREAM)


def test_context_batches_on_random_files(spark):
    """Lines shown after every batch equal the definition, whatever the size of the chunks."""
    import random

    rng = random.Random(11)
    for before, after, chunk in ((0, 2, 1 << 20), (3, 1, 3), (2, 2, 1)):
        q = LogQuery(pattern="E", before=before, after=after, ignore=("n",))
        batches = [[rng.choice(["E", "a", "b", "n", "c"]) + str(rng.random()) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        state, at, got = spark.createDataFrame([], FW.CONTEXT_SCHEMA), 0, []
        for lines in batches:
            rows = _batch(spark, [("/p", at + i, x) for i, x in enumerate(lines)] + [("/other", at, "quiet")])
            at += len(lines)
            shown, after_ = FW.context_batch(rows, state, q, chunk)
            got.append([r["line"] for r in shown.orderBy("gen", "offset").collect()])
            state = spark.createDataFrame(after_.collect(), FW.CONTEXT_SCHEMA)
        assert got == _plain_follow(batches, "E", before, after, ("n",)), (before, after, chunk)


def test_context_batch_restarts_at_a_rotation(spark):
    q = LogQuery(pattern="E", before=1, after=1)
    first = _batch(spark, [("/p", 0, "a"), ("/p", 2, "E1"), ("/q", 0, "E")])
    shown, state = FW.context_batch(first, spark.createDataFrame([], FW.CONTEXT_SCHEMA), q)
    assert sorted(r["line"] for r in shown.collect()) == ["E", "E1", "a"]
    state = spark.createDataFrame(state.collect(), FW.CONTEXT_SCHEMA)
    rows = [("/p", 0, 4, "open", "line"), ("/p", 1, -1, None, "rotated"), ("/p", 1, 0, "closed", "line"), ("/p", 1, 7, "b", "line"), ("/p", 1, 9, "E2", "line"), ("/q", 0, -1, None, "gone")]
    shown, state = FW.context_batch(_batch(spark, rows), state, q)
    assert [r["line"] for r in shown.orderBy("gen", "offset").collect()] == ["open", FW.ROTATED_NOTICE, "b", "E2"]
    left = {r["path"]: (r["seen"], r["wanted_until"], r["emitted"], [k["line"] for k in r["kept"]]) for r in state.collect()}
    assert left == {"/p": (3, 4, 3, ["E2"])}


def test_context_batch_of_one_file_uses_many_tasks(spark):
    rows = spark.range(0, 40_000, numPartitions=4).selectExpr("'/hot' AS path", "0L AS gen", "id * 100 AS offset", "IF(id % 1000 = 7, 'ERROR', 'ok') AS line", "'line' AS kind", "timestamp'2026-01-01' AS observed_at")
    shown, state = FW.context_batch(rows, spark.createDataFrame([], FW.CONTEXT_SCHEMA), LogQuery(pattern="ERROR", before=1, after=1), chunk_bytes=100_000)
    assert shown.count() == 120 and state.first()["seen"] == 40_000
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan
    # the windows over lines are inside chunks; by path alone only one row a chunk is put in order
    assert all("_bk#" in x or "_n#" in x for x in plan.split("\n") if "Window [" in x)


def test_fair_batch_says_what_is_buffered(spark):
    rows = spark.createDataFrame([("/hot", 0, 0, i, 0, f"h{i}") for i in range(50)] + [("/cold", 0, 0, 0, 0, "c")], FW.PENDING_SCHEMA)
    out, rest = FW.fair_batch(rows, 10, 30)
    got = {(r["path"], r["k"]): (r["line"], r["suffix"]) for r in out.collect()}
    assert got["/hot", 0] == ("⚠ skipped 20 older buffered lines (hot log)", "20 buffered") and got["/hot", 1] == ("h20", "20 buffered")
    assert got["/cold", 1] == ("c", None) and len(got) == 12 and rest.count() == 20
    rest.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rate_falls_with_the_heartbeat_and_sources_leave(spark, tmp_path):
    """One read of the batch, an exact rate, no rate after a silent minute."""
    import datetime as dt

    t0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    sink = WA.watch_sink(spark, str(tmp_path), LogQuery(pattern="ERROR"), keep=5)
    reads = spark.sparkContext.accumulator(0)

    def counted(rows):
        def see(parts):
            for p in parts:
                reads.add(len(p))
                yield p

        return spark.createDataFrame(rows, STREAM).coalesce(1).mapInPandas(see, STREAM)

    rows = [("/a", 0, i, f"ERROR {i % 7}", "line", t0 + dt.timedelta(seconds=i % 3)) for i in range(30)] + [("/b", 0, 0, "fine", "line", t0)]
    sink(counted(rows), 0)
    assert reads.value == 31
    head = WA.latest(spark, str(tmp_path), "header", 0).first()
    assert (head["alert_groups"], head["rate"], head["rate_capped"], head["sources"]) == (5, 30, False, 2)
    tick = lambda s: (None, None, None, None, "tick", t0 + dt.timedelta(seconds=s))
    sink(counted([tick(30), ("/b", 0, -1, None, "gone", t0 + dt.timedelta(seconds=30))]), 1)
    head = WA.latest(spark, str(tmp_path), "header", 1).first()
    assert (head["rate"], head["sources"], head["alert_groups"]) == (30, 1, 5)
    sink(counted([tick(61)]), 2)
    assert WA.latest(spark, str(tmp_path), "header", 2).first()["rate"] == 20  # the first second is past
    sink(counted([tick(63)]), 3)
    head = WA.latest(spark, str(tmp_path), "header", 3).first()
    assert (head["rate"], head["alert_groups"], head["now"]) == (0, 5, (t0 + dt.timedelta(seconds=63)).replace(tzinfo=None))


def test_the_heartbeat_stream_has_ticks(spark):
    name = "t_" + uuid.uuid4().hex[:8]
    q = _mem(WA.ticks(spark), name, os.path.join(_tmp(), "c"))
    try:
        import time

        for _ in range(100):
            time.sleep(0.2)
            if spark.table(name).count():
                break
        assert {r["kind"] for r in spark.table(name).collect()} == {"tick"}
    finally:
        q.stop()
