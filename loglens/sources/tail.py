"""``logtail`` -- a streaming source of lines appended to log files.

Spark's file stream ignores bytes appended to a file it has seen; this
source follows appends.  It is a Python data source: the driver asks the file
system for names, identities and sizes at every trigger and never opens a
file; executors read the byte ranges.

Offset (JSON)::

    {"ts": <epoch ms of the listing>,
     "files": {path: {"id": "dev:ino", "pos": <next unread byte>, "size": <bytes>,
                      "first": <size when this generation was first seen>, "gen": <generation>}}}

``pos`` is any byte: ranges are cut from sizes alone.  **A line belongs to the
range that holds its newline**; its reader looks back over the range's start
for the line's own (``lineCap`` bytes at most).  So ranges of a file can be
read by any number of tasks, an unfinished line waits for the range with its
newline, and no range depends on the text of another.  Per file:

* new since the previous offset -> its last N lines (``startingLines``) up to
  ``first``, found by the reader, then ``[first, pos)``;
* identity changed (rotated/replaced) -> first the unread end of the old
  file, found in the same directory by its identity (``rest``), then a
  marker row ``rotated`` and the new file as above.  ``gen`` counts the
  generations of a path, so rows order as ``gen, offset``;
* size below the previous position (truncated) -> marker ``truncated`` +
  ``[0, pos)``;
* otherwise ``[prev.pos, pos)``, at most ``maxBytesPerFile`` long.

Spark tells a Python source its earlier offset only when it plans a batch.
The first listing of a started (or restarted) query is therefore returned as
``{"ref": <name>}``; when its batch is planned, positions are counted from
the offset that Spark gives -- the checkpoint's -- and written under that name
to ``offsetDir`` before any range is handed out.  A replay reads them there.
So admission is the same before and after a restart.

A file that is gone leaves the offset at the next listing (marker ``gone``),
as in the original tool; one that can't be asked about (any other error) keeps its entry.

Targets: ``path`` is a comma-separated list of files, globs, directories and
group names; ``groups`` a JSON object of group name -> globs (the built-in
ones are known); ``exclude`` a comma-separated list of globs, where a hit
directory takes its subtree along (the root itself is never tested).  All are
looked up anew at every trigger.  Rotated names that a glob or directory gives
are not followed; of a directory's files only likely logs.

Other options: ``maxBytesPerFile`` (4 MiB, admission per trigger),
``startingLines`` (10: a file starts with its last N lines; ``-1`` = from its
first byte), ``lineCap`` (2 MiB: a line longer than this is emitted as
``[truncated long line] `` + its last ``lineCap`` bytes), ``splitBytes``
(64 MiB: larger ranges are read by several tasks), ``offsetDir`` (a folder the
driver can write to again after a restart; ``tail_stream`` takes the session's
shared checkpoint folder).

Output: ``path, gen, offset, line, kind ('line'|'rotated'|'truncated'|'gone'),
observed_at``.  ``offset`` is where the line starts (-1 for markers; of a cut
line, where what is left of it starts).  ``observed_at`` is the listing time
stored in the offset, so a replayed batch yields the same rows.

Identity is ``(st_dev, st_ino)`` of a shared POSIX mount; object stores have
no append, use the plain file stream there.
"""

from __future__ import annotations

import datetime as dt
import glob as _glob
import json
import os
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loglens.config import DEFAULT_LINES, FOLLOW_READ_BYTES, LINE_CAP_BYTES
from loglens.functions.glob import glob_to_regex
from loglens.functions.paths import likely_log, rotated
from loglens.operators.files import BUILTIN_GROUPS

SCHEMA = "path string, gen long, offset long, line string, kind string, observed_at timestamp"
TRUNCATED_TAG = "[truncated long line] "
BLOCK = 64 * 1024


class Targets:
    """Names of files, globs, directories and groups, less excludes; ``list`` looks them up."""

    def __init__(self, path: str, groups: str = "", exclude: str = ""):
        known = dict(BUILTIN_GROUPS) | (json.loads(groups) if groups else {})
        named = [x.strip() for x in path.split(",") if x.strip()]
        self.patterns = [os.path.expanduser(p) for x in named for p in known.get(x, [x])]
        self.excluded = [re.compile(glob_to_regex(x.strip()), re.S) for x in exclude.split(",") if x.strip()]

    def _hit(self, path: str) -> bool:
        return any(x.search(path) for x in self.excluded)

    def _walk(self, root: str):
        for d, folders, names in os.walk(root):
            folders[:] = [x for x in folders if not self._hit(os.path.join(d, x))]
            yield from (os.path.join(d, n) for n in names if likely_log(n) and not rotated(n))

    def list(self) -> list[str]:
        """Files named outright, and current (not rotated) ones that globs and directories give."""
        out: set[str] = set()
        for p in self.patterns:
            if os.path.isdir(p):
                found = self._walk(os.path.abspath(p))
            elif _glob.has_magic(p):
                root = os.path.abspath(p[: re.search(r"[*?\[]", p).start()].rsplit("/", 1)[0] or "/")
                hits = (os.path.abspath(f) for f in _glob.glob(p, recursive=True) if not rotated(os.path.basename(f)))
                found = (f for f in hits if not any(self._hit(x) for x in _below(root, f)))
            else:
                found = iter([os.path.abspath(p)])
            out.update(f for f in found if os.path.isfile(f) and not self._hit(f))
        return sorted(out)


def _below(root: str, path: str) -> list[str]:
    """The folders of path strictly below root."""
    parts = os.path.relpath(os.path.dirname(path), root).split("/")
    return [os.path.join(root, *parts[: i + 1]) for i in range(len(parts))] if parts != ["."] else []


def _last_newline(f, lo: int, hi: int) -> int:
    """Index of the last ``\\n`` in ``[lo, hi)``, or -1."""
    end = hi
    while end > lo:
        start = max(lo, end - BLOCK)
        f.seek(start)
        chunk = f.read(end - start)
        k = chunk.rfind(b"\n")
        if k >= 0:
            return start + k
        end = start
    return -1


def _last_lines_start(f, size: int, n: int) -> int:
    """Start of the last ``n`` complete lines, read backwards as far as needed."""
    if n < 0:
        return 0
    if size == 0 or n == 0:
        return size
    end = _last_newline(f, 0, size)
    for _ in range(n):
        if end < 0:
            return 0
        end = _last_newline(f, 0, end)
    return end + 1


def _find_by_id(path: str, fid: str) -> str | None:
    """A file in ``path``'s directory with identity ``fid`` (the renamed original)."""
    d = os.path.dirname(path) or "."
    try:
        with os.scandir(d) as it:
            for ent in it:
                if ent.is_file(follow_symlinks=False) and ent.path != path:
                    st = ent.stat(follow_symlinks=False)
                    if f"{st.st_dev}:{st.st_ino}" == fid:
                        return ent.path
    except OSError:
        return None
    return None


def _stat(path: str) -> tuple[str, int]:
    st = os.stat(path)
    return f"{st.st_dev}:{st.st_ino}", st.st_size


def _plan_file(path: str, prev: dict | None, max_bytes: int, start_lines: int) -> dict | None:
    """The file's entry in the next offset, from its identity and size; None if it is gone."""
    try:
        fid, size = _stat(path)
    except FileNotFoundError:
        return None
    except OSError:
        return prev
    if prev is not None and prev["id"] == fid:
        cut = size < prev["pos"]
        base, gen, first = (0, prev["gen"] + 1, 0) if cut else (prev["pos"], prev["gen"], prev["first"])
        return {"id": fid, "pos": min(size, base + max_bytes), "size": size, "first": first, "gen": gen}
    first = size if start_lines >= 0 else 0
    e = {"id": fid, "pos": first or min(size, max_bytes), "size": size, "first": first, "gen": prev["gen"] + 1 if prev else 0}
    rest = _rest_of(path, prev) if prev else None
    return e | ({"rest": rest} if rest else {})


def _rest_of(path: str, prev: dict) -> dict | None:
    """What the file renamed from ``path`` still has unread."""
    old = _find_by_id(path, prev["id"])
    try:
        size = os.stat(old).st_size if old else 0
    except OSError:
        return None
    return {"file": old, "lo": prev["pos"], "hi": size} if size > prev["pos"] else None


def _text(raw: bytes) -> str:
    """Decode and drop up to two trailing carriage returns."""
    t = raw.decode("utf-8", errors="replace")
    for _ in range(2):
        if t.endswith("\r"):
            t = t[:-1]
    return t


@dataclass
class TailRange(InputPartition):
    """Lines with their newline in ``[lo, hi)`` of a file; ``last``: only so many, the last ones;
    ``final``: the file has ended, so what follows the last newline is a line."""

    path: str
    file: str
    gen: int
    lo: int
    hi: int
    last: int | None
    final: bool
    marker: str | None
    ts: int
    cap: int


def _lines_of(f, lo: int, hi: int, cap: int, final: bool):
    """(start, text) of the lines that a range owns."""
    back = max(0, lo - cap - 1)
    f.seek(back)
    before = f.read(lo - back)
    head = before[before.rfind(b"\n") + 1 :]  # of a longer line, more than cap bytes: that is enough to know
    data = head + f.read(hi - lo)
    at, base = 0, lo - len(head)
    while True:
        nl = data.find(b"\n", at)
        end = nl if nl >= 0 else len(data)
        if nl < 0 and not (final and end > at):
            return
        long = end - at > cap
        raw = data[end - cap : end] if long else data[at:end]
        yield (base + end - cap if long else base + at), (TRUNCATED_TAG if long else "") + _text(raw)
        if nl < 0:
            return
        at = nl + 1


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.targets = Targets(options.get("path", ""), options.get("groups", ""), options.get("exclude", ""))
        self.max_bytes = int(options.get("maxBytesPerFile", FOLLOW_READ_BYTES))
        self.start_lines = int(options.get("startingLines", DEFAULT_LINES))
        self.cap = int(options.get("lineCap", LINE_CAP_BYTES))
        self.split = int(options.get("splitBytes", 64 * 1024 * 1024))
        self.refs = options.get("offsetDir", "").removeprefix("file://")
        self.known: dict | None = None  # the positions that the last offset stands for
        self.told: dict | None = None  # that offset

    def _scan(self, prev: dict) -> dict:
        files = {p: _plan_file(p, prev.get(p), self.max_bytes, self.start_lines) for p in self.targets.list()}
        return {"ts": int(time.time() * 1000), "files": {p: e for p, e in files.items() if e is not None}}

    def initialOffset(self) -> dict:
        return {"ts": 0, "files": {}}

    def latestOffset(self) -> dict:
        if self.known is None:
            if not self.refs or "://" in self.refs:
                raise ValueError("logtail needs the option offsetDir: a folder that the driver can read again after a restart")
            self.told = self.told or {"ref": uuid.uuid4().hex}
            return self.told
        now = self._scan(self.known["files"])
        old, new = (x["files"] for x in (self.known, now))
        # nothing new: the same offset again, so that no empty batch is planned
        if old.keys() != new.keys() or any(old[p][k] != new[p][k] for p in new for k in ("id", "pos", "gen")):
            self.known = self.told = now
        return self.told

    def _positions(self, offset: dict | None, start: dict | None = None) -> dict:
        """What an offset stands for; the first planning of a ``ref`` decides it."""
        if not offset or "ref" not in offset:
            return offset or {"ts": 0, "files": {}}
        name = os.path.join(self.refs, f"{offset['ref']}.json")
        if not os.path.exists(name):
            if start is None:
                raise FileNotFoundError(f"the positions of the last batch are missing: {name}")
            os.makedirs(self.refs, exist_ok=True)
            with open(f"{name}.new", "w", encoding="utf-8") as f:
                json.dump(self._scan(start["files"]), f)
            os.replace(f"{name}.new", name)
        with open(name, encoding="utf-8") as f:
            return json.load(f)

    def _ranges(self, path, file, gen, lo, hi, ts, last=None, final=False, marker=None):
        cuts = [lo, *range(lo + self.split, hi, self.split), hi] if last is None and hi > lo else [lo, hi]
        pairs = list(zip(cuts[:-1], cuts[1:]))
        return [TailRange(path, file, gen, a, b, last, final and b == hi, marker if a == lo else None, ts, self.cap) for a, b in pairs]

    def partitions(self, start: dict, end: dict):
        before = self._positions(start)
        after = self._positions(end, before)
        if self.known is None:
            self.known, self.told = after, end
        out, ts = [], after["ts"]
        for path in sorted(before["files"].keys() - after["files"].keys()):
            out.append(TailRange(path, path, before["files"][path]["gen"], 0, 0, None, False, "gone", ts, self.cap))
        for path, e in sorted(after["files"].items()):
            s, marker = before["files"].get(path), None
            if s is not None and s["id"] == e["id"] and s["gen"] == e["gen"]:
                if e["pos"] > s["pos"]:
                    out += self._ranges(path, path, e["gen"], s["pos"], e["pos"], ts)
                continue
            if s is not None:
                marker = "truncated" if s["id"] == e["id"] else "rotated"
                if r := e.get("rest"):
                    # the rest of the renamed file comes first, under the old generation
                    out += self._ranges(path, r["file"], s["gen"], r["lo"], r["hi"], ts, final=True)
            last = self.start_lines if e["first"] else None
            if e["first"] or marker:
                out += self._ranges(path, path, e["gen"], 0, e["first"], ts, last, marker=marker)
            if e["pos"] > e["first"]:
                out += self._ranges(path, path, e["gen"], e["first"], e["pos"], ts)
        return out

    def read(self, part: TailRange):
        ts = dt.datetime.fromtimestamp(part.ts / 1000.0, tz=dt.timezone.utc)
        if part.marker:
            yield (part.path, part.gen, -1, None, part.marker, ts)
        if part.hi <= part.lo:
            return
        with open(part.file, "rb") as f:
            lo = part.lo if part.last is None else _last_lines_start(f, part.hi, part.last)
            for a in range(lo, part.hi, self.split):  # a piece in memory at a time
                b = min(part.hi, a + self.split)
                for at, text in _lines_of(f, a, b, part.cap, part.final and b == part.hi):
                    yield (part.path, part.gen, at, text, "line", ts)

    def commit(self, end: dict) -> None:
        pass


class LogTailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTailReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LogTailSource)


def tail_stream(spark, path: str, **options):
    """``spark.readStream.format('logtail')`` with the given options."""
    from loglens.session import checkpoint_root

    register(spark)
    r = spark.readStream.format("logtail").option("path", path)
    options = {"offsetDir": os.path.join(checkpoint_root(spark), "logtail")} | options
    for k, v in options.items():
        r = r.option(k, json.dumps(v) if isinstance(v, dict) else str(v))
    return r.load()
