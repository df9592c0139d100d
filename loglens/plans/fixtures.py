"""Views over the driver's parquet tables that give the operators log-shaped
input (see FIXTURES.md).  Each view exists twice: a Spark builder and the
DuckDB text the oracle queries start from.

Line numbers of the event views are built with the skew-safe ordinal
(``operators.ordered``): one path may hold any share of the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.operators.ordered import ordinal, quantile_bucket

# --- fixed values: query parameters of the registered queries ---------------------
EVENT_NOW = "2024-01-31 00:00:00"
EVENT_SINCE = "2024-01-20 00:00:00"
FILES_NOW = "2001-08-02 00:00:00"
FILES_CUTOFF = "2001-07-01 00:00:00"
SYSLOG_YEAR = 2024
# ----------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(c: Column) -> Column:
    return (
        F.when(c == "error", "ERROR").when(c == "view", "WARN").when(c == "click", "DEBUG").otherwise("INFO")
    )


def _events(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"
    )
    return ev.withColumn("path", F.concat(F.lit("/srv/app"), (F.col("user_id") % 20).cast("string"), F.lit(f"/{name}")))


def _events_numbered(spark: SparkSession, sf_dir: str, name: str, n_buckets: int = 64) -> DataFrame:
    ev = _events(spark, sf_dir, name)
    x = F.unix_micros(F.col("ts"))
    b = quantile_bucket(ev, x, n_buckets, cache_key=f"{sf_dir}/events.parquet#ts#{n_buckets}")
    return ordinal(ev, ["path"], [F.col("ts"), F.col("event_id")], b, "line_no")


def _event_line() -> Column:
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), _level(F.col("event_type")),
        F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"),
        F.lit(" value="), F.format_string("%.2f", F.col("value")),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events_numbered(spark, sf_dir, "app.log")
    return ev.select("path", "line_no", _event_line().alias("line"), F.col("ts").alias("observed_at"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_lines`` without places, for what needs no order: one scan, no ordinal."""
    return _events(spark, sf_dir, "app.log").select("path", _event_line().alias("line"), F.col("ts").alias("observed_at"))


def event_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events_numbered(spark, sf_dir, "msg.log")
    line = F.concat(_level(F.col("event_type")), F.lit(" "), F.col("event_type"))
    return ev.select("path", "line_no", line.alias("line"), F.col("ts").alias("observed_at"))


def time_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines whose time is written in one of several layouts, or as
    a JSON field, chosen by ``event_id % 10``."""
    ev = _events_numbered(spark, sf_dir, "time.log")
    ts = F.col("ts")
    tail = F.concat(F.lit(" "), _level(F.col("event_type")), F.lit(" user="), F.col("user_id").cast("string"))
    k = F.col("event_id") % 10
    text = (
        F.when(k == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), tail))
        .when(k == 1, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), tail))
        .when(k == 2, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), tail))
        .when(k == 3, F.concat(F.date_format(ts, "yyyy/MM/dd HH:mm:ss"), tail))
        .when(k == 4, F.concat(F.date_format(ts, "MM/dd/yyyy HH:mm:ss"), tail))
        .when(k == 5, F.concat(F.date_format(ts, "MMM dd HH:mm:ss"), tail))
        .when(k == 6, F.concat(F.lit('{"ts": "'), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit('", "user": '),
                               F.col("user_id").cast("string"), F.lit("}")))
        .when(k == 7, F.concat(F.lit('{"time": '), F.col("user_id").cast("string"), F.lit(', "@timestamp": "'),
                               F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+01:00'"), F.lit('"}')))
        .when(k == 8, F.concat(F.date_format(ts, "yyyy-MM-dd H:mm:ss,SSS"), tail))
        .otherwise(F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type")))
    )
    return ev.select("path", "line_no", text.alias("line"), ts.alias("observed_at"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".log"))
    return d.select(path.alias("path"), F.posexplode(F.split(F.col("text"), "\n")).alias("k", "line")).select(
        "path", F.col("k").cast("long").alias("line_no"), "line"
    )


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("/chat/"), F.col("conv_id").cast("string"), F.lit(".log")).alias("path"),
        F.col("turn").cast("long").alias("line_no"),
        F.col("text").alias("line"),
    )


FILE_NAMES = ("app.log", "app.log.1", "app.log.2.gz", "error.log", "applog.conf", "access_log",
              "logs/worker.log-20260101", "debug/trace.out", "readme.md")


def files_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 9
    name = None
    for i, n in enumerate(FILE_NAMES):
        name = F.when(k == i, F.lit(n)) if name is None else name.when(k == i, F.lit(n))
    path = F.concat(F.lit("/srv/svc"), (F.col("o_custkey") % 40).cast("string"), F.lit("/"), name)
    # grouped by the two small integer keys; ``path`` is an aggregate output,
    # so later predicates on it stay above the aggregate (one row per file)
    return o.groupBy((F.col("o_custkey") % 40).alias("_c"), k.alias("_k")).agg(
        F.max(path).alias("path"),
        F.max(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.count(F.lit(1)).alias("size"),
    ).select("path", "mtime", "size")


def proc_fds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = (F.col("s_suppkey") % 40).cast("string")
    return s.select(
        F.concat(F.lit("host"), (F.col("s_suppkey") % 5).cast("string")).alias("host"),
        F.col("s_suppkey").alias("pid"),
        F.concat(F.lit("svc"), n).alias("comm"),
        F.concat(F.lit("/usr/bin/svc"), n, F.lit(" --serve")).alias("cmdline"),
        F.concat(F.lit("/srv/svc"), n, F.lit("/app.log")).alias("fd_path"),
    )


def listeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("host"), (F.col("s_suppkey") % 5).cast("string")).alias("host"),
        (F.lit(8000) + F.col("s_suppkey") % 25).cast("long").alias("port"),
        F.col("s_suppkey").alias("pid"),
    )


# ---- DuckDB text of the same views -------------------------------------------------------

_LV = ("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' "
       "WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END")

_EV = ("concat('/srv/app', CAST(user_id % 20 AS VARCHAR), '/{name}') AS path, "
       "CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS BIGINT) AS line_no")

DUCK_VIEWS = {
    "event_lines": f"""SELECT {_EV.format(name='app.log')},
        concat(strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), ' ', {_LV}, ' user=', CAST(user_id AS VARCHAR), ' ',
               event_type, ' value=', printf('%.2f', value)) AS line,
        ts AS observed_at
      FROM events""",
    "event_msgs": f"""SELECT {_EV.format(name='msg.log')},
        concat({_LV}, ' ', event_type) AS line, ts AS observed_at
      FROM events""",
    "time_lines": f"""SELECT {_EV.format(name='time.log')},
        CASE event_id % 10
          WHEN 0 THEN concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'), ' ', {_LV}, ' user=', CAST(user_id AS VARCHAR))
          WHEN 1 THEN concat(strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), ' ', {_LV}, ' user=', CAST(user_id AS VARCHAR))
          WHEN 2 THEN concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', {_LV}, ' user=', CAST(user_id AS VARCHAR))
          WHEN 3 THEN concat(strftime(ts, '%Y/%m/%d %H:%M:%S'), ' ', {_LV}, ' user=', CAST(user_id AS VARCHAR))
          WHEN 4 THEN concat(strftime(ts, '%m/%d/%Y %H:%M:%S'), ' ', {_LV}, ' user=', CAST(user_id AS VARCHAR))
          WHEN 5 THEN concat(strftime(ts, '%b %d %H:%M:%S'), ' ', {_LV}, ' user=', CAST(user_id AS VARCHAR))
          WHEN 6 THEN concat('{{"ts": "', strftime(ts, '%Y-%m-%d %H:%M:%S'), '", "user": ', CAST(user_id AS VARCHAR), '}}')
          WHEN 7 THEN concat('{{"time": ', CAST(user_id AS VARCHAR), ', "@timestamp": "', strftime(ts, '%Y-%m-%dT%H:%M:%S+01:00'), '"}}')
          WHEN 8 THEN concat(strftime(ts, '%Y-%m-%d %-H:%M:%S,%g'), ' ', {_LV}, ' user=', CAST(user_id AS VARCHAR))
          ELSE concat('user=', CAST(user_id AS VARCHAR), ' ', event_type)
        END AS line,
        ts AS observed_at
      FROM events""",
    "doc_lines": """SELECT concat('/data/', source, '/', CAST(doc_id AS VARCHAR), '.log') AS path,
        CAST(k - 1 AS BIGINT) AS line_no, l AS line
      FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l,
                   generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)""",
    "turn_lines": """SELECT concat('/chat/', CAST(conv_id AS VARCHAR), '.log') AS path,
        CAST(turn AS BIGINT) AS line_no, text AS line FROM conversations""",
    "files_v": """SELECT path, max(o_orderdate) AS mtime, CAST(count(*) AS BIGINT) AS size FROM (
        SELECT concat('/srv/svc', CAST(o_custkey % 40 AS VARCHAR), '/',
          CASE o_orderkey % 9 WHEN 0 THEN 'app.log' WHEN 1 THEN 'app.log.1' WHEN 2 THEN 'app.log.2.gz'
            WHEN 3 THEN 'error.log' WHEN 4 THEN 'applog.conf' WHEN 5 THEN 'access_log'
            WHEN 6 THEN 'logs/worker.log-20260101' WHEN 7 THEN 'debug/trace.out' ELSE 'readme.md' END) AS path,
          o_orderdate
        FROM orders) GROUP BY path""",
    "proc_fds": """SELECT concat('host', CAST(s_suppkey % 5 AS VARCHAR)) AS host, s_suppkey AS pid,
        concat('svc', CAST(s_suppkey % 40 AS VARCHAR)) AS comm,
        concat('/usr/bin/svc', CAST(s_suppkey % 40 AS VARCHAR), ' --serve') AS cmdline,
        concat('/srv/svc', CAST(s_suppkey % 40 AS VARCHAR), '/app.log') AS fd_path
      FROM supplier""",
    "listeners": """SELECT concat('host', CAST(s_suppkey % 5 AS VARCHAR)) AS host,
        CAST(8000 + s_suppkey % 25 AS BIGINT) AS port, s_suppkey AS pid FROM supplier""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the views it reads."""
    ctes = ",\n".join(f"{n} AS ({DUCK_VIEWS[n]})" for n in names)
    body = sql.lstrip()
    if body.startswith(","):  # the query adds CTEs of its own
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"


SPARK_VIEWS = {
    "event_lines": event_lines,
    "event_rows": event_rows,
    "event_msgs": event_msgs,
    "time_lines": time_lines,
    "doc_lines": doc_lines,
    "turn_lines": turn_lines,
    "files_v": files_v,
    "proc_fds": proc_fds,
    "listeners": listeners,
}
