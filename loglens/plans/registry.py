"""
shown on the driver's tables, each with its DuckDB oracle.

Every query reads the fixture views of ``fixtures`` (derived from the given
tables), runs over all of their rows, and names its output columns exactly
like its oracle.  Timestamps are rendered as text, flags as 0/1.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.config import LogQuery
from loglens.functions import paths as PH
from loglens.functions import regex as rx
from loglens.functions import timeparse as tp
from loglens.functions.glob import glob_match
from loglens.operators import files as FL
from loglens.operators import inventory as INV
from loglens.operators import lines as L
from loglens.operators import report as R
from loglens.operators.ordered import ordinal, quantile_bucket
from loglens.operators.targets import resolve_targets
from loglens.plans import duck as D
from loglens.plans import fixtures as FX
from loglens.plans.fixtures import EVENT_NOW, EVENT_SINCE, FILES_CUTOFF, SYSLOG_YEAR, with_views
from loglens.plans.search import search, snapshot
from loglens.session import new_state_dir
from loglens.sources.text import last_bytes
from loglens.streaming.follow import CONTEXT_SCHEMA, context_batch

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def tsx(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def flag(c) -> F.Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")


def V(spark, sf, name) -> DataFrame:
    # the oracles render zone-less (UTC) timestamps: read the fixtures in UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return FX.SPARK_VIEWS[name](spark, sf)


ERR_RE = rx.severity_pattern("errors")
WARN_RE = rx.severity_pattern("warnings")
SINCE_SQL = f"TIMESTAMP '{EVENT_SINCE}'"
LT_EV = D.line_time("line", SYSLOG_YEAR)

# ---- S3 / S4 --------------------------------------------------------------------------------


@register("line_numbers", with_views("SELECT path, line_no, line FROM event_lines", "event_lines"))
def q_line_numbers(spark, sf):
    return V(spark, sf, "event_lines").select("path", "line_no", "line")


WINDOW_BYTES = 4096


@register("read_window", with_views(f"""
SELECT path, line_no,
       CASE WHEN cum <= {WINDOW_BYTES} THEN line
            ELSE right(line, CAST({WINDOW_BYTES} - (cum - strlen(line) - 1) - 1 AS BIGINT)) END AS line
FROM (SELECT path, line_no, line,
             CAST(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_no DESC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
      FROM doc_lines)
WHERE cum - strlen(line) - 1 < {WINDOW_BYTES}""", "doc_lines"))
def q_read_window(spark, sf):
    return last_bytes(V(spark, sf, "doc_lines"), WINDOW_BYTES).select("path", "line_no", "line")


# ---- P1-P6, P12 -----------------------------------------------------------------------------

MATCH_RE = r"user=1[0-9]* (click|view) value=[0-9]\."


@register("match_lines", with_views(
    f"SELECT path, line_no, line FROM event_lines WHERE regexp_matches(line, {D.q(MATCH_RE)})", "event_lines"))
def q_match_lines(spark, sf):
    return V(spark, sf, "event_lines").filter(rx.match("line", MATCH_RE)).select("path", "line_no", "line")


DOC_RE = r"\b(pour|avec)\b"


@register("match_doc_lines", with_views(
    f"SELECT path, line_no, line FROM doc_lines WHERE regexp_matches(line, {D.q(DOC_RE)})", "doc_lines"))
def q_match_doc_lines(spark, sf):
    return V(spark, sf, "doc_lines").filter(rx.match("line", DOC_RE)).select("path", "line_no", "line")


@register("match_ignore_case", with_views(
    "SELECT path, line_no, line FROM event_lines WHERE regexp_matches(line, '(?i)Purchase Value=1')", "event_lines"))
def q_match_ignore_case(spark, sf):
    return V(spark, sf, "event_lines").filter(rx.match("line", "Purchase Value=1", ignore_case=True)).select(
        "path", "line_no", "line")


IGNORE = ("signup", "DEBUG")


@register("ignore_lines", with_views(
    "SELECT path, line_no, line FROM event_lines "
    "WHERE NOT (regexp_matches(line, 'signup') OR regexp_matches(line, 'DEBUG'))", "event_lines"))
def q_ignore_lines(spark, sf):
    return V(spark, sf, "event_lines").filter(~rx.ignored("line", IGNORE)).select("path", "line_no", "line")


@register("severity_errors", with_views(
    f"SELECT path, line_no, line FROM event_lines WHERE regexp_matches(line, {D.q(ERR_RE)})", "event_lines"))
def q_severity_errors(spark, sf):
    return V(spark, sf, "event_lines").filter(rx.match("line", rx.severity_pattern("ERRORS"))).select(
        "path", "line_no", "line")


@register("severity_warnings", with_views(
    f"SELECT path, line_no, line FROM event_msgs WHERE regexp_matches(line, {D.q(WARN_RE)})", "event_msgs"))
def q_severity_warnings(spark, sf):
    return V(spark, sf, "event_msgs").filter(rx.match("line", rx.severity_pattern("warning"))).select(
        "path", "line_no", "line")


@register("since_filter", with_views(
    f"SELECT path, line_no, line FROM event_lines WHERE coalesce({LT_EV}, observed_at) >= {SINCE_SQL}",
    "event_lines"))
def q_since_filter(spark, sf):
    d = V(spark, sf, "event_lines")
    return d.filter(L.since_ok(F.col("line"), F.col("observed_at"), EVENT_SINCE, SYSLOG_YEAR)).select(
        "path", "line_no", "line")


TODAY_NOW = dt.datetime(2024, 1, 15, 12, 34, 56)


@register("since_today", with_views(
    f"SELECT path, line_no, line FROM event_lines WHERE coalesce({LT_EV}, observed_at) >= TIMESTAMP '2024-01-15 00:00:00'",
    "event_lines"))
def q_since_today(spark, sf):
    since = tp.resolve_since("today", TODAY_NOW)
    d = V(spark, sf, "event_lines")
    return d.filter(L.since_ok(F.col("line"), F.col("observed_at"), since, SYSLOG_YEAR)).select(
        "path", "line_no", "line")


@register("since_relative", with_views(
    f"SELECT path, line_no, line FROM event_lines WHERE coalesce({LT_EV}, observed_at) >= TIMESTAMP '2024-01-23 00:00:00'",
    "event_lines"))
def q_since_relative(spark, sf):
    since = tp.resolve_since("1.5w", dt.datetime(2024, 2, 2, 12, 0, 0))
    d = V(spark, sf, "event_lines")
    return d.filter(L.since_ok(F.col("line"), F.col("observed_at"), since, SYSLOG_YEAR)).select(
        "path", "line_no", "line")


@register("watch_since", with_views(
    f"SELECT path, line_no, line FROM event_msgs WHERE coalesce({D.line_time('line', SYSLOG_YEAR)}, observed_at) >= {SINCE_SQL}",
    "event_msgs"))
def q_watch_since(spark, sf):
    d = V(spark, sf, "event_msgs")
    return d.filter(L.since_ok(F.col("line"), F.col("observed_at"), EVENT_SINCE, SYSLOG_YEAR)).select(
        "path", "line_no", "line")


# ---- F1-F4, F7 ---------------------------------------------------------------------------------


@register("line_time", with_views(
    f"SELECT path, line_no, line, {D.ts_text(D.line_time('line', SYSLOG_YEAR))} AS t FROM time_lines", "time_lines"))
def q_line_time(spark, sf):
    return V(spark, sf, "time_lines").select("path", "line_no", "line", tsx(tp.line_time("line", SYSLOG_YEAR)).alias("t"))


@register("prefix_time", with_views(
    f"SELECT path, line_no, line, {D.ts_text(D.prefix_time(D.trim_space('line'), SYSLOG_YEAR))} AS t FROM time_lines",
    "time_lines"))
def q_prefix_time(spark, sf):
    return V(spark, sf, "time_lines").select(
        "path", "line_no", "line", tsx(tp.prefix_time(tp.trim_space("line"), SYSLOG_YEAR)).alias("t"))


@register("json_time", with_views(
    f"SELECT path, line_no, line, {D.ts_text(D.json_time('line', SYSLOG_YEAR))} AS t FROM time_lines", "time_lines"))
def q_json_time(spark, sf):
    return V(spark, sf, "time_lines").select("path", "line_no", "line", tsx(tp.json_time("line", SYSLOG_YEAR)).alias("t"))


def _duck_level(expr: str) -> str:
    parts = " ".join(f"WHEN regexp_matches({expr}, {D.q(chr(40) + '?i' + chr(41) + chr(92) + 'b(' + w + ')' + chr(92) + 'b')}) THEN '{n}'"
                     for n, w in rx.LEVEL_WORDS)
    return f"CASE {parts} ELSE '{rx.NO_LEVEL}' END"


@register("level_of_line", with_views(
    f"SELECT path, line_no, {_duck_level('line')} AS level FROM event_lines "
    f"UNION ALL SELECT path, line_no, {_duck_level('line')} AS level FROM doc_lines", "event_lines", "doc_lines"))
def q_level_of_line(spark, sf):
    a = V(spark, sf, "event_lines").select("path", "line_no", rx.level("line").alias("level"))
    b = V(spark, sf, "doc_lines").select("path", "line_no", rx.level("line").alias("level"))
    return a.unionByName(b)


_DUCK_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_DUCK_DIR = "CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END"


@register("path_parts", with_views(f"""
SELECT path, {_DUCK_BASE} AS base, {_DUCK_DIR} AS dir,
       regexp_extract({_DUCK_BASE}, '(\\.[^./]*)$', 1) AS ext,
       left({_DUCK_BASE}, length({_DUCK_BASE}) - length(regexp_extract({_DUCK_BASE}, '(\\.[^./]*)$', 1))) AS stem
FROM files_v""", "files_v"))
def q_path_parts(spark, sf):
    p = F.col("path")
    b = PH.base_name(p)
    return V(spark, sf, "files_v").select(
        "path", b.alias("base"), PH.dir_name(p).alias("dir"), PH.extension(b).alias("ext"), PH.stem(b).alias("stem"))


# ---- P7-P11, P13 on the file view ----------------------------------------------------------------

GLOBS = ("/srv/svc1*/*.log", "/srv/**/*.out", "/srv/svc?/app.log*", "/srv/**", "/srv/*/logs/*")
GLOB_RES_BY_HAND = (r"^/srv/svc1[^/]*/[^/]*\.log$", r"^/srv/(.*/)?[^/]*\.out$", r"^/srv/svc[^/]/app\.log[^/]*$",
                    r"^/srv/.*$", r"^/srv/[^/]*/logs/[^/]*$")


@register("glob_filter", with_views(
    "SELECT path, " + ", ".join(f"CAST(regexp_matches(path, {D.q(r)}) AS BIGINT) AS m{i}"
                                for i, r in enumerate(GLOB_RES_BY_HAND)) + " FROM files_v", "files_v"))
def q_glob_filter(spark, sf):
    return V(spark, sf, "files_v").select("path", *[flag(glob_match("path", g)).alias(f"m{i}") for i, g in enumerate(GLOBS)])


EXCLUDES = ("/srv/svc1/**", "/srv/svc2*/logs", "**/debug")


@register("exclude_filter", with_views(
    "SELECT path FROM files_v WHERE NOT (regexp_matches(path, '^/srv/svc1/') "
    "OR regexp_matches(path, '^/srv/svc2[^/]*/logs/') OR regexp_matches(path, '/debug/'))", "files_v"))
def q_exclude_filter(spark, sf):
    return V(spark, sf, "files_v").filter(~FL.excluded(F.col("path"), EXCLUDES, "/srv")).select("path")


_DB = "lower(regexp_extract(path, '([^/]*)$', 1))"
_DB_NOGZ = f"CASE WHEN ends_with({_DB}, '.gz') THEN left({_DB}, length({_DB}) - 3) ELSE {_DB} END"
_DEXT = f"regexp_extract({_DB_NOGZ}, '(\\.[^./]*)$', 1)"
DUCK_IS_LOG = (f"({_DEXT} IN ('.log', '.out', '.err', '.txt') OR contains({_DB_NOGZ}, '.log.') "
               f"OR {_DB_NOGZ} IN ('access_log', 'error_log', 'stdout', 'stderr', 'current') "
               f"OR ({_DEXT} = '' AND contains({_DB_NOGZ}, 'log')))")
DUCK_IS_ROT = (f"(ends_with({_DB}, '.gz') OR (contains({_DB}, '.log.') AND split_part({_DB}, '.log.', 2) <> '') "
               f"OR contains({_DB}, '.log-'))")


@register("likely_log", with_views(f"SELECT path, CAST({DUCK_IS_LOG} AS BIGINT) AS is_log FROM files_v", "files_v"))
def q_likely_log(spark, sf):
    return V(spark, sf, "files_v").select("path", flag(PH.is_log("path")).alias("is_log"))


@register("rotated_split", with_views(f"SELECT path, CAST({DUCK_IS_ROT} AS BIGINT) AS is_rotated FROM files_v", "files_v"))
def q_rotated_split(spark, sf):
    return V(spark, sf, "files_v").select("path", flag(PH.is_rotated("path")).alias("is_rotated"))


@register("recent_files", with_views(
    f"SELECT path, {D.ts_text('mtime')} AS mtime FROM files_v WHERE mtime >= TIMESTAMP '{FILES_CUTOFF}'", "files_v"))
def q_recent_files(spark, sf):
    return FL.recent(V(spark, sf, "files_v"), FILES_CUTOFF).select("path", tsx("mtime").alias("mtime"))


@register("current_only", with_views(f"SELECT path FROM files_v WHERE NOT {DUCK_IS_ROT}", "files_v"))
def q_current_only(spark, sf):
    return FL.current_only(V(spark, sf, "files_v")).select("path")


@register("file_catalog", with_views(
    f"SELECT path, {D.ts_text('mtime')} AS mtime, size FROM files_v "
    f"WHERE starts_with(path, '/srv/') AND {DUCK_IS_LOG} AND NOT {DUCK_IS_ROT} "
    f"AND NOT regexp_matches(path, '/debug/') AND mtime >= TIMESTAMP '1998-01-01 00:00:00'", "files_v"))
def q_file_catalog(spark, sf):
    c = FL.catalog(V(spark, sf, "files_v"), ["/srv"], ["**/debug"], "1998-01-01 00:00:00", history=False)
    return c.select("path", tsx("mtime").alias("mtime"), "size")


# ---- L1-L3 ----------------------------------------------------------------------------------------------

_CAT_SQL = f"SELECT * FROM files_v WHERE starts_with(path, '/srv/') AND {DUCK_IS_LOG}"


@register("newest_files", with_views(
    f"SELECT path, {D.ts_text('mtime')} AS mtime FROM ({_CAT_SQL} AND NOT {DUCK_IS_ROT}) "
    "ORDER BY mtime DESC, path LIMIT 20", "files_v"))
def q_newest_files(spark, sf):
    c = FL.catalog(V(spark, sf, "files_v"), ["/srv"])
    return FL.newest(c, 20).select("path", tsx("mtime").alias("mtime"))


@register("newest_files_history", with_views(
    f"SELECT path, {D.ts_text('mtime')} AS mtime FROM ({_CAT_SQL}) ORDER BY mtime DESC, path LIMIT 100", "files_v"))
def q_newest_files_history(spark, sf):
    c = FL.catalog(V(spark, sf, "files_v"), ["/srv"], history=True)
    return FL.newest(c, 20, history=True).select("path", tsx("mtime").alias("mtime"))


@register("history_order", with_views(
    f"SELECT path, CAST(row_number() OVER (ORDER BY mtime, path) - 1 AS BIGINT) AS pos "
    f"FROM ({_CAT_SQL})", "files_v"))
def q_history_order(spark, sf):
    c = FL.catalog(V(spark, sf, "files_v"), ["/srv"], history=True)
    return FL.history_positions(c).select("path", "pos")


_SCORE_SQL = """CASE
  WHEN lower(regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '([^/]*)$', 1)) = 'svc1' THEN 100
  WHEN left(lower(regexp_extract(path, '([^/]*)$', 1)), length(lower(regexp_extract(path, '([^/]*)$', 1)))
       - length(regexp_extract(lower(regexp_extract(path, '([^/]*)$', 1)), '(\\.[^./]*)$', 1))) = 'svc1' THEN 95
  WHEN contains(lower(regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '([^/]*)$', 1)), 'svc1') THEN 80
  WHEN contains(lower(regexp_extract(path, '([^/]*)$', 1)), 'svc1') THEN 70
  WHEN contains(lower(path), '/svc1/') THEN 90
  WHEN contains(lower(path), 'svc1') THEN 40 ELSE 0 END"""


@register("find_source", with_views(
    f"SELECT path, CAST(score AS BIGINT) AS score FROM (SELECT path, mtime, {_SCORE_SQL} AS score FROM ({_CAT_SQL})) "
    "WHERE score > 0 ORDER BY score DESC, mtime DESC, path LIMIT 20", "files_v"))
def q_find_source(spark, sf):
    c = FL.catalog(V(spark, sf, "files_v"), ["/srv"], history=True)
    return FL.find_source(c, "svc1", 20).select("path", "score")


# ---- J1, J2, U1, A6, J6, U2 ------------------------------------------------------------------------------

GROUPS = {
    "api": ["/srv/svc1/*.log", "/srv/svc1/app.log.1"],
    "svc2": ["/srv/svc2/**"],
    "debug": ["/srv/svc3/debug"],
    "workers": ["/srv/*/logs/*"],
}
_GROUP_MATCH_SQL = f"""
  SELECT 'api' AS name, path FROM files_v WHERE (regexp_matches(path, '^/srv/svc1/[^/]*\\.log$') AND NOT {DUCK_IS_ROT})
                                            OR path = '/srv/svc1/app.log.1'
  UNION SELECT 'svc2', path FROM files_v WHERE regexp_matches(path, '^/srv/svc2/.*$') AND NOT {DUCK_IS_ROT}
  UNION SELECT 'debug', path FROM files_v WHERE starts_with(path, '/srv/svc3/debug/') AND NOT {DUCK_IS_ROT}
  UNION SELECT 'workers', path FROM files_v WHERE regexp_matches(path, '^/srv/[^/]*/logs/[^/]*$') AND NOT {DUCK_IS_ROT}"""
_GROUP_FILES_SQL = f"SELECT name, path FROM ({_GROUP_MATCH_SQL}) g WHERE {DUCK_IS_LOG}"


@register("group_files", with_views(_GROUP_FILES_SQL, "files_v"))
def q_group_files(spark, sf):
    return FL.resolve_groups(V(spark, sf, "files_v"), GROUPS)


_SOURCE_PATHS_SQL = f"""
, gf AS ({_GROUP_FILES_SQL}), cat AS ({_CAT_SQL} AND NOT {DUCK_IS_ROT}),
a AS (SELECT regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS root, path FROM cat)
SELECT name, 'group' AS kind, CAST(NULL AS VARCHAR) AS root, path FROM gf
UNION ALL SELECT name, 'auto', root, path FROM a WHERE name NOT IN ('api', 'svc2', 'debug', 'workers', 'mysql')"""


@register("source_paths", with_views(_SOURCE_PATHS_SQL, "files_v"))
def q_source_paths(spark, sf):
    return FL.source_paths(V(spark, sf, "files_v"), GROUPS, ["/srv"])


# A table of groups: several patterns for every customer, and excludes from the suppliers.
_MANY_GROUPS = ("/srv/svc{}/*.log", "/srv/svc{}/**", "/srv/svc{}/**/app.lo?", "/srv/svc{}/app.log.1", "/srv/*{}/logs/*", "/srv/svc{}/debug", "/srv/svc{}/logs/work*", "/srv/svc{}/er[ror].log")


@register("group_table", with_views(f"""
, pats AS (SELECT 'g' || c_custkey AS name, replace(p, '{{}}', CAST(c_custkey % 97 AS VARCHAR)) AS pattern
          FROM customer, (VALUES {', '.join(f"('{p}')" for p in _MANY_GROUPS)}) AS t(p)),
k AS (SELECT DISTINCT pattern, regexp_matches(pattern, '[*?\\[]') AS is_glob,
            '^' || replace(replace(replace(replace(replace(replace(replace(regexp_replace(pattern, '([.\\[\\]])', '\\\\\\1', 'g'),
              '**/', chr(1)), '**', chr(2)), '*', chr(3)), '?', '[^/]'), chr(1), '(?:.*/)?'), chr(2), '.*'), chr(3), '[^/]*') || '$' AS regex FROM pats),
f AS (SELECT pattern, path, NOT is_glob AND path = pattern AS explicit FROM k JOIN files_v
      ON CASE WHEN is_glob THEN regexp_matches(path, regex) ELSE path = pattern OR starts_with(path, pattern || '/') END),
x AS (SELECT DISTINCT path FROM files_v JOIN supplier ON starts_with(path, '/srv/svc' || CAST(s_suppkey % 7 AS VARCHAR) || '/logs/'))
SELECT DISTINCT name, path FROM pats JOIN f USING (pattern)
WHERE {DUCK_IS_LOG} AND (explicit OR NOT {DUCK_IS_ROT}) AND path NOT IN (SELECT path FROM x)""", "files_v"))
def q_group_table(spark, sf):
    """J2 with a table of patterns: a look-up by literal root, whatever its size."""
    of = lambda c: F.explode(F.array(*(F.replace(F.lit(p), F.lit("{}"), c) for p in _MANY_GROUPS)))
    groups = FX.table(spark, sf, "customer").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("name"), of((F.col("c_custkey") % 97).cast("string")).alias("pattern"))
    excludes = FX.table(spark, sf, "supplier").select(F.concat(F.lit("/srv/svc"), (F.col("s_suppkey") % 7).cast("string"), F.lit("/logs")).alias("pattern"))
    return FL.resolve_group_table(V(spark, sf, "files_v"), FL.groups_table(spark).unionByName(groups), excludes)


@register("source_list", with_views(f"""
, gf AS ({_GROUP_FILES_SQL}),
     names AS (SELECT * FROM (VALUES ('api'), ('svc2'), ('debug'), ('workers'), ('mysql')) t(name)),
     g AS (SELECT names.name, 'group' AS kind, CAST(NULL AS VARCHAR) AS root,
                  CAST(coalesce(c.n, 0) AS BIGINT) AS n_files
           FROM names LEFT JOIN (SELECT name, count(*) AS n FROM gf GROUP BY name) c ON c.name = names.name),
     cat AS ({_CAT_SQL} AND NOT {DUCK_IS_ROT}),
     a AS (SELECT regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '([^/]*)$', 1) AS name, 'auto' AS kind,
                  regexp_extract(path, '^(.*)/[^/]*$', 1) AS root, CAST(count(*) AS BIGINT) AS n_files
           FROM cat GROUP BY regexp_extract(path, '^(.*)/[^/]*$', 1))
SELECT * FROM g UNION ALL SELECT * FROM a WHERE name NOT IN (SELECT name FROM names)""", "files_v"))
def q_source_list(spark, sf):
    return FL.list_sources(V(spark, sf, "files_v"), GROUPS, ["/srv"])


_SIB_SQL = f"""
, sel AS (SELECT path FROM files_v WHERE ends_with(path, '/app.log')),
     f AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM files_v),
     sib AS (SELECT f.path FROM f JOIN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
                                               regexp_extract(path, '([^/]*)$', 1) AS base FROM sel) s
               ON f.dir = s.dir AND (starts_with(f.name, s.base || '.') OR starts_with(f.name, s.base || '-')))
SELECT DISTINCT path FROM (SELECT path FROM sel UNION ALL SELECT path FROM sib) u WHERE {DUCK_IS_LOG}"""


@register("rotated_siblings", with_views(_SIB_SQL, "files_v"))
def q_rotated_siblings(spark, sf):
    f = V(spark, sf, "files_v")
    return FL.rotated_siblings(f.filter(F.col("path").endswith("/app.log")), f)


@register("union_sources", with_views(f"""
SELECT DISTINCT path FROM (
  SELECT path FROM ({_GROUP_FILES_SQL}) WHERE name = 'api'
  UNION ALL SELECT path FROM files_v WHERE regexp_matches(path, '^/srv/svc3/[^/]*\\.log$') AND {DUCK_IS_LOG} AND NOT {DUCK_IS_ROT}
  UNION ALL SELECT path FROM files_v WHERE path IN ('/srv/svc4/app.log', '/srv/svc5/error.log')) u
WHERE path <> ''""", "files_v"))
def q_union_sources(spark, sf):
    f = V(spark, sf, "files_v")
    a = FL.resolve_groups(f, {"api": GROUPS["api"]}, builtin=False)
    b = FL.resolve_groups(f, {"t": ["/srv/svc3/*.log"]}, builtin=False)
    targets = FL.split_targets(["/srv/svc4/app.log,/srv/svc5/error.log"])
    c = FL.resolve_groups(f, {"t": targets}, builtin=False)
    return FL.union_sources(a, b, c)


@register("unique_paths", with_views("""
SELECT DISTINCT path FROM (SELECT path FROM event_lines UNION ALL SELECT path FROM event_msgs
                           UNION ALL SELECT path FROM files_v UNION ALL SELECT '' AS path) u WHERE path <> ''""",
    "event_lines", "event_msgs", "files_v"))
def q_unique_paths(spark, sf):
    u = V(spark, sf, "event_rows").select("path").unionByName(V(spark, sf, "event_msgs").select("path")).unionByName(
        V(spark, sf, "files_v").select("path")).unionByName(spark.range(1).select(F.lit("").alias("path")))
    return FL.unique_paths(u)


def _snapshot_new(f: DataFrame) -> DataFrame:
    k = F.col("size") % 6
    g = f.filter(k != 0)
    return g.select(
        F.when(k == 5, F.concat(F.col("path"), F.lit(".new"))).otherwise(F.col("path")).alias("path"),
        F.when(k.isin(1, 5), F.md5(F.concat(F.col("path"), F.lit("#2")))).otherwise(F.md5(F.col("path"))).alias("file_id"),
        F.when(k == 2, F.col("size") - 1).when(k == 3, F.col("size") + 10).otherwise(F.col("size")).alias("size"),
    )


_SNAP_SQL = """
old AS (SELECT path, md5(path) AS file_id, size FROM files_v),
new AS (SELECT CASE WHEN size % 6 = 5 THEN path || '.new' ELSE path END AS path,
               CASE WHEN size % 6 IN (1, 5) THEN md5(path || '#2') ELSE md5(path) END AS file_id,
               CASE WHEN size % 6 = 2 THEN size - 1 WHEN size % 6 = 3 THEN size + 10 ELSE size END AS size
        FROM files_v WHERE size % 6 <> 0)"""


@register("snapshot_diff", with_views(f""", {_SNAP_SQL}
SELECT coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed'
       WHEN o.file_id <> n.file_id THEN 'rotated' WHEN n.size < o.size THEN 'truncated'
       WHEN n.size > o.size THEN 'appended' ELSE 'unchanged' END AS status,
  o.size AS old_size, n.size AS new_size
FROM old o FULL OUTER JOIN new n ON o.path = n.path""", "files_v"))
def q_snapshot_diff(spark, sf):
    f = V(spark, sf, "files_v")
    old = f.select("path", F.md5(F.col("path")).alias("file_id"), "size")
    return FL.diff_snapshots(old, _snapshot_new(f))


@register("removed_sources", with_views(f""", {_SNAP_SQL}
SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)""", "files_v"))
def q_removed_sources(spark, sf):
    f = V(spark, sf, "files_v")
    return FL.removed_sources(f.select("path"), _snapshot_new(f))


# ---- J4 / J5 / J8 ------------------------------------------------------------------------------------


@register("process_logs", with_views(f"""
SELECT DISTINCT host, pid, fd_path AS path FROM proc_fds
WHERE contains(lower(trim(comm) || ' ' || replace(cmdline, chr(0), ' ')), 'svc1')
  AND starts_with(fd_path, '/') AND fd_path IN (SELECT path FROM files_v)""", "proc_fds", "files_v"))
def q_process_logs(spark, sf):
    return INV.logs_of_process(V(spark, sf, "proc_fds"), "SVC1", V(spark, sf, "files_v"))


@register("port_logs", with_views("""
SELECT DISTINCT o.host, o.port, o.pid, p.fd_path AS path
FROM (SELECT host, port, min(pid) AS pid FROM listeners WHERE port = 8003 GROUP BY host, port) o
JOIN proc_fds p ON p.host = o.host AND p.pid = o.pid
WHERE p.fd_path IN (SELECT path FROM files_v)""", "listeners", "proc_fds", "files_v"))
def q_port_logs(spark, sf):
    return INV.logs_of_port(V(spark, sf, "listeners"), V(spark, sf, "proc_fds"), 8003, V(spark, sf, "files_v"))


# a group, a port, a glob and a ranked name; no siblings, as current files only
_TARGETS_SQL = f"""
, t AS (
  SELECT path FROM files_v WHERE regexp_matches(path, '^/srv/svc2/') AND NOT {DUCK_IS_ROT} AND {DUCK_IS_LOG}
  UNION SELECT p.fd_path FROM (SELECT host, port, min(pid) AS pid FROM listeners WHERE port = 8003 GROUP BY host, port) o
    JOIN proc_fds p ON p.host = o.host AND p.pid = o.pid WHERE p.fd_path IN (SELECT path FROM files_v)
  UNION SELECT path FROM files_v WHERE regexp_matches(path, '^/srv/svc5/[^/]*\\.log$') AND NOT {DUCK_IS_ROT} AND {DUCK_IS_LOG}
  UNION SELECT path FROM (SELECT path, mtime, {_SCORE_SQL} AS score FROM ({_CAT_SQL} AND NOT {DUCK_IS_ROT}))
    WHERE score > 0 AND path IN (SELECT path FROM (SELECT path, row_number() OVER (ORDER BY score DESC, mtime DESC, path) AS r
      FROM (SELECT path, mtime, {_SCORE_SQL} AS score FROM ({_CAT_SQL} AND NOT {DUCK_IS_ROT})) WHERE score > 0) WHERE r <= 20))
SELECT path FROM t"""


@register("resolve_targets", with_views(_TARGETS_SQL, "files_v", "listeners", "proc_fds"))
def q_resolve_targets(spark, sf):
    return resolve_targets(V(spark, sf, "files_v"), ["svc2, :8003", "/srv/svc5/*.log", "svc1"], ["/srv"], {"svc2": ["/srv/svc2/**"]},
                           V(spark, sf, "proc_fds"), V(spark, sf, "listeners"), history=False)


HOSTS = [("host0", "linux", "ubuntu debian"), ("host1", "linux", "centos rhel fedora"),
         ("host2", "linux", "opensuse-leap suse opensuse"), ("host3", "linux", "arch"),
         ("host4", "linux", "plan9"), ("host5", "darwin", "")]
SYS_NAMES = {"app.log": "syslog", "app.log.1": "syslog.1", "app.log.2.gz": "messages-20240101.gz",
             "error.log": "secure", "applog.conf": "emerge.log", "access_log": "auth.log",
             "logs/worker.log-20260101": "Xorg.0.log", "debug/trace.out": "journal/system.journal",
             "readme.md": "warn"}


def _host_files(f: DataFrame) -> DataFrame:
    rest = F.regexp_extract(F.col("path"), r"^/srv/svc[0-9]+/(.*)$", 1)
    name = None
    for k, v in SYS_NAMES.items():
        name = F.when(rest == k, F.lit(v)) if name is None else name.when(rest == k, F.lit(v))
    host = F.concat(F.lit("host"), (F.regexp_extract(F.col("path"), r"^/srv/svc([0-9]+)/", 1).cast("int") % 6).cast("string"))
    return f.select(host.alias("host"), F.concat(F.lit("/var/log/"), name).alias("path"), "size").groupBy(
        "host", "path").agg(F.sum("size").alias("size"))


_HOST_FILES_SQL = ("SELECT host, path, CAST(sum(size) AS BIGINT) AS size FROM (SELECT concat('host', "
                   "CAST(CAST(regexp_extract(path, '^/srv/svc([0-9]+)/', 1) AS INT) % 6 AS VARCHAR)) AS host, "
                   "concat('/var/log/', CASE regexp_extract(path, '^/srv/svc[0-9]+/(.*)$', 1) "
                   + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYS_NAMES.items())
                   + " END) AS path, size FROM files_v) GROUP BY host, path")
_FAM_SQL = {
    "host0": ["/var/log/journal/", "/var/log/audit/", "^/var/log/daemon\\.log", "^/var/log/syslog", "^/var/log/kern\\.log",
              "^/var/log/auth\\.log", "^/var/log/boot\\.log", "^/var/log/dmesg"],
    "host1": ["/var/log/journal/", "/var/log/audit/", "^/var/log/messages", "^/var/log/secure", "^/var/log/boot\\.log",
              "^/var/log/dmesg"],
    "host2": ["/var/log/journal/", "/var/log/audit/", "^/var/log/messages", "^/var/log/warn", "^/var/log/localmessages",
              "^/var/log/boot\\.msg", "^/var/log/firewall"],
    "host3": ["/var/log/journal/", "/var/log/audit/", "^/var/log/Xorg\\.[^/]*\\.log[^/]*$"],
    "host4": ["/var/log/journal/", "/var/log/audit/", "^/var/log/daemon\\.log", "^/var/log/syslog", "^/var/log/kern\\.log",
              "^/var/log/auth\\.log", "^/var/log/boot\\.log", "^/var/log/dmesg", "^/var/log/messages", "^/var/log/secure",
              "^/var/log/warn", "^/var/log/localmessages", "^/var/log/boot\\.msg", "^/var/log/firewall",
              "^/var/log/Xorg\\.[^/]*\\.log[^/]*$"],
    "host5": ["/var/log/journal/", "/var/log/audit/"],
}


def _fam_cond() -> str:
    parts = []
    for h, regs in _FAM_SQL.items():
        ors = " OR ".join(f"regexp_matches(path, {D.q(r if r.startswith('^') else '^' + r)})" for r in regs)
        parts.append(f"(host = '{h}' AND ({ors}))")
    return " OR ".join(parts)


@register("system_log_excludes", with_views(
    f"SELECT host, path, size FROM ({_HOST_FILES_SQL}) WHERE NOT ({_fam_cond()})", "files_v"))
def q_system_log_excludes(spark, sf):
    hosts = spark.createDataFrame(HOSTS, "host string, os string, ids string")
    return FL.exclude_system_logs(_host_files(V(spark, sf, "files_v")), hosts, "/var/log").select("host", "path", "size")


# ---- W1-W8, J3, A1, A5/S7 ---------------------------------------------------------------------------------

CTX_SINCE = "2024-01-05 00:00:00"
CTX_Q = LogQuery(pattern="error", ignore=("signup",), since=CTX_SINCE, before=2, after=1)
_CTX_FLAGS = f"""flagged AS (
  SELECT path, line_no, line,
         NOT regexp_matches(line, 'signup') AND coalesce({LT_EV}, observed_at) >= TIMESTAMP '{CTX_SINCE}' AS elig
  FROM event_lines),
hits AS (SELECT *, elig AND regexp_matches(line, 'error') AS hit FROM flagged),
sel AS (SELECT path, line_no, line, hit FROM (
  SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near
  FROM hits) WHERE elig AND near = 1)"""


def _ctx_sql(select: str) -> str:
    return with_views(f", {_CTX_FLAGS}\n{select}", "event_lines")


@register("context_lines", _ctx_sql("SELECT path, line_no, line FROM sel"))
def q_context_lines(spark, sf):
    rows = L.select_lines(V(spark, sf, "event_lines"), CTX_Q, "observed_at", SYSLOG_YEAR, markers=False)
    return rows.select("path", "line_no", "line")


@register("context_join", _ctx_sql("SELECT path, line_no, line FROM sel"))
def q_context_join(spark, sf):
    f = L.flag_lines(V(spark, sf, "event_lines"), CTX_Q, "observed_at", SYSLOG_YEAR)
    return L.context(f, CTX_Q.before, CTX_Q.after, plan="join").select("path", "line_no", "line")


@register("context_gaps", _ctx_sql("""
SELECT path, line_no, CAST(1 AS BIGINT) AS sub, line FROM sel
UNION ALL
SELECT path, line_no, CAST(0 AS BIGINT) AS sub, '--' AS line FROM (
  SELECT path, line_no, lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM sel)
WHERE prev IS NOT NULL AND line_no - prev > 1"""))
def q_context_gaps(spark, sf):
    rows = search(V(spark, sf, "event_lines"), CTX_Q, "observed_at", SYSLOG_YEAR)
    return rows.select("path", "line_no", F.col("sub").cast("long").alias("sub"), "line")


@register("gaps_small_blocks", ORACLES["context_gaps"])
def q_gaps_small_blocks(spark, sf):
    rows = search(V(spark, sf, "event_lines"), CTX_Q, "observed_at", SYSLOG_YEAR, "bucket", 3)
    return rows.select("path", "line_no", F.col("sub").cast("long").alias("sub"), "line")


@register("match_counts", _ctx_sql(
    "SELECT path, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS matches FROM sel GROUP BY ROLLUP (path)"))
def q_match_counts(spark, sf):
    # only direct matches count: context and markers can't change the result
    hits = L.flag_lines(V(spark, sf, "event_rows"), CTX_Q, "observed_at", SYSLOG_YEAR).filter("is_match")
    return R.match_counts(hits.withColumn("is_gap", F.lit(False)))


JSON_NOW = EVENT_NOW


@register("json_blocks", _ctx_sql(
    "SELECT path, CAST(0 AS BIGINT) AS part, json_object('path', path, 'time', '2024-01-31T00:00:00Z', "
    "'suffix', CAST(sum(CAST(is_match AS INT)) OVER (PARTITION BY path) AS VARCHAR) || ' matches', "
    "'lines', list(line ORDER BY line_no, sub) OVER (PARTITION BY path)) AS json "
    "FROM (SELECT path, line_no, 1 AS sub, line, hit AS is_match FROM sel UNION ALL "
    "SELECT path, line_no, 0 AS sub, '--' AS line, false AS is_match FROM ("
    "SELECT path, line_no, lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM sel) "
    "WHERE prev IS NOT NULL AND line_no - prev > 1) QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) = 1"))
def q_json_blocks(spark, sf):
    rows = search(V(spark, sf, "event_lines"), CTX_Q, "observed_at", SYSLOG_YEAR)
    return R.to_json_blocks(R.blocks(rows, JSON_NOW)).select("path", "part", "json")


PART_BYTES = 4000


@register("json_parts", _ctx_sql(
    "SELECT path, CAST(part AS BIGINT) AS part, json_object('path', path, 'time', '2024-01-31T00:00:00Z', "
    "'suffix', CAST(total AS VARCHAR) || ' matches', 'lines', list(line ORDER BY line_no, sub)) AS json FROM ("
    "SELECT *, dense_rank() OVER (PARTITION BY path ORDER BY cut) - 1 AS part, sum(CAST(is_match AS INT)) OVER (PARTITION BY path) AS total FROM ("
    "SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_no, sub "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {PART_BYTES} AS cut "
    "FROM (SELECT path, line_no, 1 AS sub, line, hit AS is_match FROM sel UNION ALL "
    "SELECT path, line_no, 0 AS sub, '--' AS line, false AS is_match FROM ("
    "SELECT path, line_no, lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM sel) "
    "WHERE prev IS NOT NULL AND line_no - prev > 1))) GROUP BY path, part, total"))
def q_json_parts(spark, sf):
    """Blocks cut at a small byte budget: gapless parts, the source's total in each."""
    rows = search(V(spark, sf, "event_lines"), CTX_Q, "observed_at", SYSLOG_YEAR)
    return R.to_json_blocks(R.blocks(rows, JSON_NOW, max_bytes=PART_BYTES)).select("path", "part", "json")


@register("search_default_since", with_views("""
SELECT path, line_no, line FROM event_lines
WHERE coalesce(""" + LT_EV + """, observed_at) >= TIMESTAMP '2024-01-30 00:00:00' AND regexp_matches(line, 'purchase')""", "event_lines"))
def q_search_default_since(spark, sf):
    """A pattern without a time bound searches the 24 hours before now."""
    q = LogQuery(pattern="purchase").with_defaults(dt.datetime.fromisoformat(EVENT_NOW))
    return search(V(spark, sf, "event_lines"), q, "observed_at", SYSLOG_YEAR).filter(~F.col("is_gap")).select("path", "line_no", "line")


# RE2 patterns whose Java reading differs or doesn't compile
DIALECT = (
    r"(?P<who>user=\d+)\b", r"[[:upper:]]{4,} [[:alpha:]]+=", r"value=[[:digit:]]+\.0{2}$", r"\pL+\s\z|click", r"(?i)PURCHASE\x20value", r"\Quser=1\E\b",
    r"[^[:space:]]{12}", r"(?s)user.*value", r"(?:view|click)[[:blank:]]",
)


@register("regex_dialect", with_views(
    "SELECT p AS pattern, count(*) AS lines, min(line) AS first FROM event_lines, "
    f"(VALUES {', '.join(f'({D.q(p)})' for p in DIALECT)}) AS t(p) WHERE regexp_matches(line, p) GROUP BY p", "event_lines"))
def q_regex_dialect(spark, sf):
    """what RE2 patterns match, line by line, after their translation."""
    d = V(spark, sf, "event_rows")
    hits = F.array_compact(F.array(*(F.when(rx.match(F.col("line"), p), F.lit(p)) for p in DIALECT)))
    return d.select("line", F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"))


FOLLOW_Q = LogQuery(pattern="error", ignore=("signup",), before=2, after=1)
FOLLOW_CUT = 150  # lines of a file in the first batch


@register("follow_context_batch", with_views("""
, e AS (SELECT path, line_no, line, row_number() OVER (PARTITION BY path ORDER BY line_no) AS pos,
               regexp_matches(line, 'error') AS hit
        FROM event_lines WHERE NOT regexp_matches(line, 'signup'))
SELECT path, line_no, line FROM (
  SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM e)
WHERE near = 1""", "event_lines"))
def q_follow_context_batch(spark, sf):
    """The stream's context rules over two micro-batches, the second going on from the first one's state."""
    rows = V(spark, sf, "event_lines").select(
        "path", F.lit(0).cast("long").alias("gen"), F.col("line_no").alias("offset"), "line", F.lit("line").alias("kind"), F.col("observed_at").cast("timestamp").alias("observed_at"))
    none = spark.createDataFrame([], CONTEXT_SCHEMA)
    whole = new_state_dir(spark, "follow-rows")
    rows.write.parquet(whole)  # as the sink does with a micro-batch
    rows = spark.read.parquet(whole)
    first, state = context_batch(rows.filter(F.col("offset") < FOLLOW_CUT), none, FOLLOW_Q, chunk_bytes=64)
    at = new_state_dir(spark, "follow-context")
    state.write.parquet(at)
    second, _ = context_batch(rows.filter(F.col("offset") >= FOLLOW_CUT), spark.read.schema(CONTEXT_SCHEMA).parquet(at), FOLLOW_Q, chunk_bytes=64)
    return first.unionByName(second).select("path", F.col("offset").alias("line_no"), "line")


@register("dedup_runs", with_views("""
, s AS (SELECT path, line_no, line,
               CASE WHEN lag(line) OVER w IS DISTINCT FROM line THEN 1 ELSE 0 END AS b
        FROM event_msgs WINDOW w AS (PARTITION BY path ORDER BY line_no)),
r AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT path, min(line_no) AS line_no,
       CASE WHEN count(*) > 1 THEN concat(min(line), '  × ', CAST(count(*) AS VARCHAR)) ELSE min(line) END AS line
FROM r GROUP BY path, run""", "event_msgs"))
def q_dedup_runs(spark, sf):
    rows = search(V(spark, sf, "event_msgs"), LogQuery(dedup=True), "observed_at", SYSLOG_YEAR)
    return rows.select("path", "line_no", "line")


@register("dedup_small_blocks", ORACLES["dedup_runs"])
def q_dedup_small_blocks(spark, sf):
    rows = search(V(spark, sf, "event_msgs"), LogQuery(dedup=True), "observed_at", SYSLOG_YEAR, bucket_width=5)
    return rows.select("path", "line_no", "line")


@register("drop_repeats", with_views("""
SELECT path, line_no, line FROM (
  SELECT path, line_no, line, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM event_msgs)
WHERE prev IS DISTINCT FROM line""", "event_msgs"))
def q_drop_repeats(spark, sf):
    return L.drop_repeats(V(spark, sf, "event_msgs").select("path", "line_no", "line"))


@register("tail_lines", with_views("""
SELECT path, line_no, line FROM event_lines
QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) <= 5""", "event_lines"))
def q_tail_lines(spark, sf):
    return L.tail_lines(V(spark, sf, "event_lines"), 5).select("path", "line_no", "line")


@register("tail_turns", with_views("""
SELECT path, line_no, line FROM turn_lines
QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) <= 2""", "turn_lines"))
def q_tail_turns(spark, sf):
    return L.tail_lines(V(spark, sf, "turn_lines"), 2).select("path", "line_no", "line")


TURN_RE = r"(?i)\bavec\b"


@register("context_turns", with_views(f"""
SELECT path, line_no FROM (
  SELECT path, line_no, max(CAST(regexp_matches(line, {D.q(TURN_RE)}) AS INT))
         OVER (PARTITION BY path ORDER BY line_no RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near
  FROM turn_lines) WHERE near = 1""", "turn_lines"))
def q_context_turns(spark, sf):
    q = LogQuery(pattern=TURN_RE, before=1, after=1)
    f = L.flag_lines(V(spark, sf, "turn_lines").withColumn("file_mtime", F.lit(None).cast("timestamp")), q)
    return L.context(f, 1, 1, plan="join").select("path", "line_no")


@register("fair_batches", with_views("""
SELECT path, line_no, CAST(floor((row_number() OVER (PARTITION BY path ORDER BY line_no) - 1) / 10) AS BIGINT) AS round
FROM event_lines WHERE regexp_matches(line, 'ERROR')""", "event_lines"))
def q_fair_batches(spark, sf):
    d = V(spark, sf, "event_lines").filter(rx.match("line", "ERROR"))
    return L.fair_batches(d, 10).select("path", "line_no", "round")


@register("cap_pending", with_views("""
SELECT path, line_no, line, CAST(greatest(count(*) OVER (PARTITION BY path) - 50, 0) AS BIGINT) AS dropped
FROM event_lines WHERE regexp_matches(line, 'ERROR')
QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) <= 50""", "event_lines"))
def q_cap_pending(spark, sf):
    d = V(spark, sf, "event_lines").filter(rx.match("line", "ERROR"))
    return L.cap_pending(d, 50).select("path", "line_no", "line", "dropped")


SNAP_Q = LogQuery(pattern="WARN", before=1, after=1)


@register("snapshot", with_views("""
, last AS (SELECT path, line_no, line FROM event_lines
           QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) <= 40),
h AS (SELECT *, regexp_matches(line, 'WARN') AS hit FROM last),
sel AS (SELECT path, line_no, line FROM (
  SELECT *, max(CAST(hit AS INT)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near
  FROM h) WHERE near = 1)
SELECT path, line_no, CAST(1 AS BIGINT) AS sub, line FROM sel
UNION ALL
SELECT path, line_no, CAST(0 AS BIGINT) AS sub, '--' AS line FROM (
  SELECT path, line_no, lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM sel)
WHERE prev IS NOT NULL AND line_no - prev > 1""", "event_lines"))
def q_snapshot(spark, sf):
    rows = snapshot(V(spark, sf, "event_lines"), 10, SNAP_Q, "observed_at", SYSLOG_YEAR)
    return rows.select("path", "line_no", F.col("sub").cast("long").alias("sub"), "line")


@register("snapshot_small_blocks", ORACLES["snapshot"])
def q_snapshot_small_blocks(spark, sf):
    rows = snapshot(V(spark, sf, "event_lines"), 10, SNAP_Q, "observed_at", SYSLOG_YEAR, bucket_width=7)
    return rows.select("path", "line_no", F.col("sub").cast("long").alias("sub"), "line")


# ---- A2, A3, A3b, A7, L4 ------------------------------------------------------------------------------------


@register("alert_groups", with_views(f"""
SELECT path AS source, line, CAST(count(*) AS BIGINT) AS count, {D.ts_text('min(observed_at)')} AS first,
       {D.ts_text('max(observed_at)')} AS last
FROM event_msgs WHERE regexp_matches(line, 'ERROR|WARN') GROUP BY path, line""", "event_msgs"))
def q_alert_groups(spark, sf):
    ev = V(spark, sf, "event_msgs").filter(rx.match("line", "ERROR|WARN")).withColumnRenamed("path", "source")
    a = R.alert_groups(ev)
    return a.select("source", "line", "count", tsx("first").alias("first"), tsx("last").alias("last"))


@register("top_alerts", with_views(f"""
SELECT source, line, count, {D.ts_text('first')} AS first, {D.ts_text('last')} AS last FROM (
  SELECT path AS source, line, CAST(count(*) AS BIGINT) AS count, min(observed_at) AS first, max(observed_at) AS last
  FROM event_lines WHERE regexp_matches(line, {D.q(ERR_RE)}) GROUP BY path, line)
ORDER BY last DESC, count DESC, source, line LIMIT 200""", "event_lines"))
def q_top_alerts(spark, sf):
    ev = V(spark, sf, "event_rows").filter(rx.match("line", rx.severity_pattern("errors")))
    a = R.top_alerts(R.alert_groups(ev.withColumnRenamed("path", "source")))
    return a.select("source", "line", "count", tsx("first").alias("first"), tsx("last").alias("last"))


RATE_NOW = "2024-01-15 12:00:00"


@register("trailing_rate", with_views(f"""
SELECT CAST(count(*) AS BIGINT) AS rate, CAST(count(*) > 100000 AS BIGINT) AS rate_capped
FROM event_lines WHERE observed_at BETWEEN TIMESTAMP '{RATE_NOW}' - INTERVAL 1 HOUR AND TIMESTAMP '{RATE_NOW}'""",
    "event_lines").replace("INTERVAL 1 HOUR", "INTERVAL 60 SECOND"))
def q_trailing_rate(spark, sf):
    ev = V(spark, sf, "event_rows").withColumnRenamed("observed_at", "at")
    r = R.trailing_rate(ev, RATE_NOW)
    return r.select("rate", flag(F.col("rate_capped")).alias("rate_capped"))


@register("rate_series", with_views("""
, per AS (SELECT CAST(floor(epoch_us(observed_at) / 1000000) AS BIGINT) AS sec, count(*) AS n FROM event_lines GROUP BY 1)
SELECT strftime(to_timestamp(a.sec), '%Y-%m-%d %H:%M:%S') AS second, CAST(sum(b.n) AS BIGINT) AS rate
FROM per a JOIN per b ON b.sec BETWEEN a.sec - 60 AND a.sec GROUP BY a.sec""", "event_lines"))
def q_rate_series(spark, sf):
    ev = V(spark, sf, "event_rows").withColumnRenamed("observed_at", "at")
    r = R.rate_series(ev)
    return r.select(F.date_format("second", "yyyy-MM-dd HH:mm:ss").alias("second"), "rate")


@register("watch_header", with_views(f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT path, line FROM event_msgs WHERE regexp_matches(line, 'ERROR'))) AS alert_groups,
       (SELECT CAST(count(*) AS BIGINT) FROM event_msgs WHERE regexp_matches(line, 'ERROR')
          AND observed_at BETWEEN TIMESTAMP '{RATE_NOW}' - INTERVAL 60 SECOND AND TIMESTAMP '{RATE_NOW}') AS rate,
       CAST(0 AS BIGINT) AS rate_capped,
       (SELECT CAST(count(DISTINCT path) AS BIGINT) FROM event_msgs) AS sources""", "event_msgs"))
def q_watch_header(spark, sf):
    msgs = V(spark, sf, "event_msgs")
    ev = msgs.filter(rx.match("line", "ERROR")).withColumnRenamed("path", "source").withColumnRenamed("observed_at", "at")
    h = R.watch_header(R.alert_groups(ev, "at"), R.trailing_rate(ev, RATE_NOW), msgs)
    return h.select("alert_groups", "rate", flag(F.col("rate_capped")).alias("rate_capped"), "sources")


# ---- S8: the preset table against each host's files ---------------------------------------------


def _preset_values() -> str:
    rows = ", ".join(f"({D.q(f)}, {D.q(p)}, {D.q(r)})" for f, p, r in FL.preset_rows())
    return f"presets(family, pattern, regex) AS (VALUES {rows})"


_HOST_FAMILY_SQL = """hosts(host, os, ids) AS (VALUES """ + ", ".join(
    f"({D.q(h)}, {D.q(o)}, {D.q(i)})" for h, o, i in HOSTS) + """),
hf AS (SELECT host, CASE WHEN lower(os) <> 'linux' THEN 'other'
  WHEN list_has_any(string_split(lower(ids), ' '), ['debian','ubuntu','linuxmint','raspbian']) THEN 'debian'
  WHEN list_has_any(string_split(lower(ids), ' '), ['rhel','centos','fedora','rocky','almalinux','amzn']) THEN 'rhel'
  WHEN list_has_any(string_split(lower(ids), ' '), ['sles','opensuse','opensuse-leap','opensuse-tumbleweed']) THEN 'suse'
  WHEN list_has_any(string_split(lower(ids), ' '), ['arch','manjaro']) THEN 'arch'
  WHEN list_has_any(string_split(lower(ids), ' '), ['alpine']) THEN 'alpine'
  WHEN list_has_any(string_split(lower(ids), ' '), ['gentoo']) THEN 'gentoo'
  ELSE 'unknown' END AS family FROM hosts)"""


@register("preset_hits", with_views(
    f", {_preset_values()}, {_HOST_FAMILY_SQL}, hfiles AS ({_HOST_FILES_SQL})\n"
    "SELECT f.host, f.path, p.pattern FROM hfiles f JOIN hf ON hf.host = f.host "
    "JOIN presets p ON p.family = hf.family AND regexp_matches(f.path, p.regex)", "files_v"))
def q_preset_hits(spark, sf):
    hosts = spark.createDataFrame(HOSTS, "host string, os string, ids string")
    return FL.preset_hits(_host_files(V(spark, sf, "files_v")), hosts, FL.exclude_presets(spark))


# ---- plain search (no context): filter first, markers over the selected lines -------------------

PLAIN_RE = r"ERROR user=\d+ error value=[0-4]"


@register("search_plain", with_views(f"""
, sel AS (SELECT path, line_no, line FROM event_lines WHERE regexp_matches(line, {D.q(PLAIN_RE)}))
SELECT path, line_no, CAST(1 AS BIGINT) AS sub, line FROM sel
UNION ALL
SELECT path, line_no, CAST(0 AS BIGINT) AS sub, '--' AS line FROM (
  SELECT path, line_no, lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM sel)
WHERE prev IS NOT NULL AND line_no - prev > 1""", "event_lines"))
def q_search_plain(spark, sf):
    rows = search(V(spark, sf, "event_lines"), LogQuery(pattern=PLAIN_RE), "observed_at", SYSLOG_YEAR)
    return rows.select("path", "line_no", F.col("sub").cast("long").alias("sub"), "line")
