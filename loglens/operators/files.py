"""File-set operators: catalog filters (S5, P7-P11, P13), joins (J1, J2,
J6-J8), rankings (L1-L3), source list (A4/J7), unique paths (A6) and set
operations (U1, U2).

A ``files`` DataFrame has ``path, mtime, size`` (optionally ``file_id``,
``host``).  Config-sized inputs (group globs, exclude globs, distribution
presets) are compiled to regexes on the driver; they are bounded by
configuration, not by data, so they become filter expressions or
broadcast sides of a fixed, known size.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.config import DEFAULT_MAX_FILES, HISTORY_FILE_FACTOR
from loglens.functions.glob import clean, glob_to_regex, has_meta
from loglens.functions.paths import base_name, dir_name, extension, is_log, is_rotated
from loglens.functions.timeparse import ts_literal
from loglens.operators.ordered import ordinal, quantile_bucket

# --- fixed values: built-in source group and distribution presets ----------------------
BUILTIN_GROUPS = {
    "mysql": (
        "/var/log/mysql/*.log", "/var/log/mysql/*.err",
        "/var/log/mariadb/*.log", "/var/log/mariadb/*.err",
        "/var/log/mysqld.log", "/var/lib/mysql/*.log", "/var/lib/mysql/*.err",
        "/usr/local/var/mysql/*.log", "/usr/local/var/mysql/*.err",
        "/opt/homebrew/var/mysql/*.log", "/opt/homebrew/var/mysql/*.err",
    ),
}
LOOKUP_SCORES = {"directory": 100, "stem": 95, "in directory": 80, "in base": 70, "segment": 90, "in path": 40}
COMMON_EXCLUDES = ("/var/log/journal/**", "/var/log/audit/**")
PRESETS = {
    "debian": ("/var/log/daemon.log*", "/var/log/syslog*", "/var/log/kern.log*", "/var/log/auth.log*",
               "/var/log/boot.log*", "/var/log/dmesg*"),
    "rhel": ("/var/log/messages*", "/var/log/secure*", "/var/log/boot.log*", "/var/log/dmesg*"),
    "suse": ("/var/log/messages*", "/var/log/warn*", "/var/log/localmessages*", "/var/log/boot.msg*",
             "/var/log/firewall*"),
    "arch": ("/var/log/Xorg.*.log*",),
    "alpine": ("/var/log/messages*", "/var/log/warn*"),
    "gentoo": ("/var/log/messages*", "/var/log/emerge.log*"),
}
# distribution ids of each family, in the order families are tried
FAMILY_IDS = (
    ("debian", ("debian", "ubuntu", "linuxmint", "raspbian")),
    ("rhel", ("rhel", "centos", "fedora", "rocky", "almalinux", "amzn")),
    ("suse", ("sles", "opensuse", "opensuse-leap", "opensuse-tumbleweed")),
    ("arch", ("arch", "manjaro")),
    ("alpine", ("alpine",)),
    ("gentoo", ("gentoo",)),
)
UNKNOWN_LINUX_FAMILIES = ("debian", "rhel", "suse", "arch", "alpine")
# ------------------------------------------------------------------------------------------


def _ts(t) -> Column:
    return t if isinstance(t, Column) else ts_literal(t)


def family_patterns(family: str) -> list[str]:
    """Exclude globs of a family: common first, then the family's, unique."""
    if family == "other":
        fams: tuple[str, ...] = ()
    elif family == "unknown":
        fams = UNKNOWN_LINUX_FAMILIES
    else:
        fams = (family,)
    out = list(COMMON_EXCLUDES)
    for f in fams:
        for p in PRESETS[f]:
            if p not in out:
                out.append(p)
    return out


def preset_rows() -> list[tuple[str, str, str]]:
    return [(f, p, glob_to_regex(p)) for f in [*PRESETS, "unknown", "other"] for p in family_patterns(f)]


def exclude_presets(spark: SparkSession) -> DataFrame:
    """``(family, pattern, regex)`` for every family, incl. 'unknown' and 'other'."""
    return spark.createDataFrame(preset_rows(), "family string, pattern string, regex string")


def preset_hits(files: DataFrame, hosts: DataFrame, presets: DataFrame) -> DataFrame:
    """S8 as a table: which preset pattern of its host's family hits each file.

    ``presets`` has a fixed size (the preset list), so it is broadcast; the
    join is an equi-join on ``family`` with the regex as residual.
    """
    hf = host_family(hosts)
    j = files.join(hf, "host").join(F.broadcast(presets), "family")
    return j.filter(F.expr("regexp_like(path, regex)")).select("host", "path", "pattern")


def groups_table(spark: SparkSession, mapping: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``(name, pattern)``; the built-in groups are added."""
    m = dict(BUILTIN_GROUPS) | dict(mapping or {})
    return spark.createDataFrame([(name, p) for name, pats in m.items() for p in pats], "name string, pattern string")


def pattern_index(patterns: DataFrame) -> DataFrame:
    """A table of globs with ``root`` (the folder above their first wildcard; the
    whole of a literal pattern), ``is_glob`` and ``regex`` (F5 as a column)."""
    p = F.regexp_replace(F.regexp_replace("pattern", "/+", "/"), "(?<=.)/$", "")
    is_glob = p.rlike(r"[*?\[]")
    root = F.when(is_glob, F.regexp_extract(p, r"^([^*?\[]*)/", 1)).otherwise(p)
    regex = F.regexp_replace(p, r"([^A-Za-z0-9_/\s*?])", r"\\$1")
    # the longest token first; a mark keeps what it becomes from being read again
    tokens = (("**/", "\x01", "(?:.*/)?"), ("**", "\x02", ".*"), ("*", "\x03", "[^/]*"), ("?", "\x04", "[^/]"))
    for token, mark, _ in tokens:
        regex = F.replace(regex, F.lit(token), F.lit(mark))
    for _, mark, meaning in tokens:
        regex = F.replace(regex, F.lit(mark), F.lit(meaning))
    return patterns.withColumns({"root": root, "is_glob": is_glob, "regex": F.concat(F.lit("(?s)^"), regex, F.lit("$"))})


def match_patterns(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """J2/P8 for pattern tables of any size: every column of ``patterns`` and
    ``path, explicit`` for each file that a pattern selects (a literal one
    names the file, ``explicit``, or a folder above it).

    A file is looked up under each of its folders and its own name, so the
    match is an equi-join on a pattern's literal root with the regex as
    residual: no pattern meets a file outside its root.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    places = files.select("path", F.explode(above).alias("root"))
    index = pattern_index(patterns)
    found = places.join(index, "root").filter(~F.col("is_glob") | F.expr("regexp_like(path, regex)"))
    return found.select(*patterns.columns, "path", (~F.col("is_glob") & (F.col("path") == F.col("root"))).alias("explicit"))


def resolve_group_table(files: DataFrame, groups: DataFrame, excludes: DataFrame | None = None, history: bool = False) -> DataFrame:
    """J2 with the groups (``name, pattern``) and excludes (``pattern``) as
    tables: ``(name, path)``; the rules are those of ``resolve_groups``."""
    found = match_patterns(files, groups.select("name", "pattern"))
    path = F.col("path")
    out = found.filter(is_log(path) & (F.col("explicit") | F.lit(history) | ~is_rotated(path))).select("name", "path").distinct()
    if excludes is None:
        return out
    hit = match_patterns(files, excludes.select("pattern").distinct())
    return out.join(hit.select("path").distinct(), "path", "left_anti").select("name", "path")


# ---- P8: excludes ------------------------------------------------------------------------------------

def candidates(path: Column, root: str | None) -> Column:
    """The path and each ancestor directory strictly below ``root``."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    if root:
        r = clean(root)
        start = F.lit(len([p for p in r.split("/")]) + 1) if r != "/" else F.lit(2)
    else:
        start = F.lit(2)
    idx = F.sequence(F.least(start, depth), depth)
    return F.transform(idx, lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def excluded(path: Column, patterns: Iterable[str], root: str | None = None) -> Column:
    """Path, or a directory above it below ``root``, hits an exclude glob."""
    regs = [glob_to_regex(p) for p in patterns]
    if not regs:
        return F.lit(False)
    return F.exists(candidates(path, root), _matcher(regs))


def _any_rlike(c: Column, regs: Sequence[str]) -> Column:
    cond = F.lit(False)
    for r in regs:
        cond = cond | c.rlike(r)
    return cond


# ---- S5 / L1 / L2 / P11 / P13 -------------------------------------------------------------------------

def under(path: Column, roots: Sequence[str]) -> Column:
    cond = F.lit(False)
    for r in roots:
        rr = clean(r).rstrip("/")
        cond = cond | path.startswith(rr + "/")
    return cond


def catalog(
    files: DataFrame,
    roots: Sequence[str],
    excludes: Sequence[str] = (),
    cutoff=None,
    history: bool = False,
) -> DataFrame:
    """Regular likely logs below ``roots``, excluded subtrees dropped,
    rotated files only with ``history``, only files modified at/after
    ``cutoff``; newest first, path as tie-break.  A file below two roots
    is listed once."""
    p = F.col("path")
    cond = under(p, roots) & is_log(p)
    if not history:
        cond = cond & ~is_rotated(p)
    if cutoff is not None:
        cond = cond & (F.col("mtime").cast("timestamp") >= _ts(cutoff))
    out = files.filter(cond)
    if excludes:
        ex = F.lit(False)
        for r in roots:
            ex = ex | (under(p, [r]) & excluded(p, excludes, r))
        out = out.filter(~ex)
    return out


def newest(files: DataFrame, k: int = DEFAULT_MAX_FILES, history: bool = False) -> DataFrame:
    """L1: newest files first (path breaks ties), ``k`` of them (5x with history)."""
    lim = max(k * HISTORY_FILE_FACTOR, k) if history else k
    return files.orderBy(F.col("mtime").desc(), "path").limit(lim)


def history_order(files: DataFrame, current_only: bool = False) -> DataFrame:
    """L2: oldest first (history reads forward); path order with ``current_only``."""
    if current_only:
        return files.orderBy("path")
    return files.orderBy("mtime", "path")


def history_positions(files: DataFrame, buckets: int = 256) -> DataFrame:
    """L2 as a column: ``pos``, the place in the order of ``history_order``.

    Buckets of about equal size by time, one window in each; no global sort.
    """
    at = F.unix_micros(F.col("mtime").cast("timestamp"))
    return ordinal(files, [], [F.col("mtime"), F.col("path")], quantile_bucket(files, at, buckets), "pos")


def recent(files: DataFrame, cutoff) -> DataFrame:
    """Modified at or after ``cutoff``."""
    return files.filter(F.col("mtime").cast("timestamp") >= _ts(cutoff))


def current_only(files: DataFrame) -> DataFrame:
    """Drop rotated files."""
    return files.filter(~is_rotated(F.col("path")))


# ---- L3: ranked lookup -----------------------------------------------------------------------------------

def find_source(files: DataFrame, name: str, k: int = DEFAULT_MAX_FILES) -> DataFrame:
    """L3: score files against a name (``LOOKUP_SCORES``); the first rule that
    holds wins.  Newest first inside a score."""
    needle = name.lower()
    # the parts are columns of their own, so the score below stays small
    staged = files.withColumn("_lp", F.lower(F.col("path"))).withColumn(
        "_base", F.lower(base_name(F.col("path")))).withColumn("_d", F.lower(base_name(dir_name(F.col("path")))))
    lp, base, d = F.col("_lp"), F.col("_base"), F.col("_d")
    stem = base.substr(F.lit(1), F.length(base) - F.length(extension(base)))
    score = (
        F.when(d == needle, LOOKUP_SCORES["directory"])
        .when(stem == needle, LOOKUP_SCORES["stem"])
        .when(d.contains(needle), LOOKUP_SCORES["in directory"])
        .when(base.contains(needle), LOOKUP_SCORES["in base"])
        .when(lp.contains("/" + needle + "/"), LOOKUP_SCORES["segment"])
        .when(lp.contains(needle), LOOKUP_SCORES["in path"])
        .otherwise(0)
    )
    return (
        staged.withColumn("score", score.cast("long"))
        .filter(F.col("score") > 0)
        .orderBy(F.col("score").desc(), F.col("mtime").desc(), "path")
        .limit(k)
        .drop("_lp", "_base", "_d")
    )


# ---- J2 / J1 / U1 / A6 ------------------------------------------------------------------------------------

def resolve_groups(
    files: DataFrame,
    groups: Mapping[str, Sequence[str]],
    excludes: Sequence[str] = (),
    history: bool = False,
    builtin: bool = True,
) -> DataFrame:
    """``(name, path)`` for every file some pattern of a group selects.

    Globs select by full-path match; a literal pattern naming a file selects
    it even when rotated; one naming a directory selects the files below it.
    Groups are configuration (bounded, known on the driver), so each group
    becomes one predicate with literal regexes and the match is a single
    pass over ``files``: an array of the group names a file belongs to,
    exploded.  No join, no regex compiled per row.
    """
    m = dict(BUILTIN_GROUPS) if builtin else {}
    m.update(groups)
    p = F.col("path")
    names = []
    for name, pats in m.items():
        by_glob = F.lit(False)
        explicit = F.lit(False)
        for pat in pats:
            if has_meta(pat):
                by_glob = by_glob | p.rlike(glob_to_regex(pat))
            else:
                lit = clean(pat)
                explicit = explicit | (p == lit)
                by_glob = by_glob | p.startswith(lit.rstrip("/") + "/")
        keep = (by_glob & is_log(p) & (F.lit(history) | ~is_rotated(p))) | (explicit & is_log(p))
        names.append(F.when(keep, F.lit(name)))
    if not names:
        return files.select(F.lit(None).cast("string").alias("name"), p.alias("path")).limit(0)
    out = files.select(F.explode(F.array(*names)).alias("name"), p.alias("path")).filter(F.col("name").isNotNull())
    if excludes:
        out = out.filter(~excluded(F.col("path"), excludes))
    return out.distinct()


def rotated_siblings(paths: DataFrame, files: DataFrame, excludes: Sequence[str] = ()) -> DataFrame:
    """The given paths plus every likely log in the same directory named
    ``<base>.…`` or ``<base>-…``; distinct.

    A sibling's name starts with the selected base followed by ``.`` or
    ``-``, so each file name is cut before each of its ``.``/``-`` into its
    few candidate bases (``app.log.2.gz`` -> ``app``, ``app.log``,
    ``app.log.2``).  The match is then an equi-join on ``(dir, base)``:
    never all pairs of a large directory.
    """
    sel = paths.select("path").join(files.select("path"), "path", "left_semi")
    s = sel.select(dir_name(F.col("path")).alias("dir"), base_name(F.col("path")).alias("base")).distinct()
    name = base_name(F.col("path"))
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))),
                    lambda i: F.substring(name, i + 1, 1).isin(".", "-"))
    cand = files.select(
        "path", dir_name(F.col("path")).alias("dir"),
        F.explode(F.transform(cuts, lambda i: F.substring(name, 1, i))).alias("base"),
    )
    sib = cand.join(s, ["dir", "base"], "left_semi").select("path")
    out = sel.unionByName(sib).filter(is_log(F.col("path")))
    if excludes:
        out = out.filter(~excluded(F.col("path"), excludes))
    return out.distinct()


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Several resolved targets -> one distinct path set."""
    out = dfs[0].select("path")
    for d in dfs[1:]:
        out = out.unionByName(d.select("path"))
    return unique_paths(out)


def unique_paths(df: DataFrame) -> DataFrame:
    """Distinct paths, empty strings dropped (sorted on output)."""
    return df.select("path").filter(F.col("path").isNotNull() & (F.col("path") != "")).distinct()


def split_targets(raw: Sequence[str]) -> list[str]:
    """Comma-separated target arguments -> trimmed, non-empty targets."""
    out = []
    for r in raw:
        out.extend(t.strip() for t in r.split(",") if t.strip())
    return out


# ---- J6 / U2 -----------------------------------------------------------------------------------------------

def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per path new / removed / rotated / truncated / appended / unchanged.

    A full outer join on ``path`` (unique on each side, so no hot key).
    """
    o = old.select("path", F.col("file_id").alias("old_id"), F.col("size").alias("old_size"))
    n = new.select("path", F.col("file_id").alias("new_id"), F.col("size").alias("new_size"))
    j = o.join(n, "path", "full_outer")
    status = (
        F.when(F.col("old_id").isNull() & F.col("old_size").isNull(), "new")
        .when(F.col("new_id").isNull() & F.col("new_size").isNull(), "removed")
        .when(~F.col("old_id").eqNullSafe(F.col("new_id")), "rotated")
        .when(F.col("new_size") < F.col("old_size"), "truncated")
        .when(F.col("new_size") > F.col("old_size"), "appended")
        .otherwise("unchanged")
    )
    return j.select("path", status.alias("status"), "old_size", "new_size")


def removed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths gone since the last scan."""
    return old.select("path").join(new.select("path"), "path", "left_anti")


# ---- J8 -------------------------------------------------------------------------------------------------------

def host_family(hosts: DataFrame) -> DataFrame:
    """``hosts(host, os, ids)`` -> ``(host, family)``; ``ids`` holds the
    space-separated ID and ID_LIKE values."""
    ids = F.split(F.lower(F.trim(F.col("ids"))), " +")
    fam = None
    for name, vals in FAMILY_IDS:
        cond = F.lit(False)
        for v in vals:
            cond = cond | F.array_contains(ids, v)
        fam = F.when(cond, F.lit(name)) if fam is None else fam.when(cond, F.lit(name))
    fam = F.when(F.lower(F.col("os")) != "linux", F.lit("other")).otherwise(fam.otherwise(F.lit("unknown")))
    return hosts.select("host", fam.alias("family"))


def exclude_system_logs(files: DataFrame, hosts: DataFrame, root: str | None = None) -> DataFrame:
    """Drop each host's files hit by its distribution's presets.

    The preset set is fixed and small, so it is one expression per family
    (no join); the only join is ``files -> hosts`` on ``host``.
    """
    hf = host_family(hosts)
    j = files.join(hf, "host", "left")
    fam = F.coalesce(F.col("family"), F.lit("unknown"))
    cands = candidates(F.col("path"), root)
    cond = F.lit(False)
    for f in [*PRESETS, "unknown", "other"]:
        regs = [glob_to_regex(p) for p in family_patterns(f)]
        cond = cond | ((fam == f) & F.exists(cands, _matcher(regs)))
    return j.filter(~cond).drop("family")


def _matcher(regs: Sequence[str]):
    return lambda c: _any_rlike(c, regs)


# ---- A4 / J7 ------------------------------------------------------------------------------------------------------

def list_sources(
    files: DataFrame,
    groups: Mapping[str, Sequence[str]],
    roots: Sequence[str],
    excludes: Sequence[str] = (),
) -> DataFrame:
    """A4: groups (with file counts, 0 when empty) and one auto source per
    directory of the catalog; an auto source named like a group is hidden
    (J7).  Ordered by kind, name."""
    gf = resolve_groups(files, groups, excludes)
    spark = files.sparkSession
    allg = dict(BUILTIN_GROUPS)
    allg.update(groups)
    gnames = spark.createDataFrame([(n,) for n in allg], "name string")
    gcounts = gnames.join(gf.groupBy("name").agg(F.count(F.lit(1)).alias("n_files")), "name", "left").select(
        "name", F.lit("group").alias("kind"), F.lit(None).cast("string").alias("root"),
        F.coalesce(F.col("n_files"), F.lit(0)).cast("long").alias("n_files"),
    )
    cat = catalog(files, roots, excludes)
    auto = cat.groupBy(dir_name(F.col("path")).alias("root")).agg(F.count(F.lit(1)).alias("n_files")).select(
        base_name(F.col("root")).alias("name"), F.lit("auto").alias("kind"), "root",
        F.col("n_files").cast("long").alias("n_files"),
    )
    auto = auto.join(F.broadcast(gnames), "name", "left_anti")
    return gcounts.unionByName(auto.select(*gcounts.columns))


def source_paths(files: DataFrame, groups: Mapping[str, Sequence[str]], roots: Sequence[str], excludes: Sequence[str] = ()) -> DataFrame:
    """A4's ``paths`` as rows: ``name, kind, root, path`` of every file of every
    source of ``list_sources`` (a source may hold any number of files)."""
    of_group = resolve_groups(files, groups, excludes).select("name", F.lit("group").alias("kind"), F.lit(None).cast("string").alias("root"), "path")
    root = dir_name(F.col("path"))
    auto = catalog(files, roots, excludes).select(base_name(root).alias("name"), F.lit("auto").alias("kind"), root.alias("root"), "path")
    return of_group.unionByName(auto.filter(~F.col("name").isin(*{*BUILTIN_GROUPS, *groups})))


# ---- J4 / J5 live in inventory.py --------------------------------------------------------------------------------


def files_schema() -> T.StructType:
    return T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("size", T.LongType()),
    ])
