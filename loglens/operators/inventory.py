"""Process and port selectors (J4, J5) over inventory tables.

The original tool reads ``/proc`` and ``lsof``/``ss`` on one machine; here
those facts are tables collected per host:
``proc_fds(host, pid, comm, cmdline, fd_path)`` and
``listeners(host, port, pid)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.functions.paths import is_log, process_text

DELETED_SUFFIX = " (deleted)"


def _open_logs(fds: DataFrame, files: DataFrame | None) -> DataFrame:
    p = F.when(F.col("fd_path").endswith(DELETED_SUFFIX),
               F.expr(f"substring(fd_path, 1, length(fd_path) - {len(DELETED_SUFFIX)})")).otherwise(F.col("fd_path"))
    out = fds.withColumn("path", p).filter(F.col("path").startswith("/") & is_log(F.col("path")))
    if files is not None:
        # the file must exist: semi join with the file catalog
        out = out.join(files.select("path"), "path", "left_semi")
    return out


def logs_of_process(fds: DataFrame, selector: str, files: DataFrame | None = None) -> DataFrame:
    """Open log files of processes named ``selector`` (substring of
    lower(comm + ' ' + cmdline)) or of the PID ``selector`` when it is all
    digits.  Distinct ``(host, pid, path)``."""
    if selector.isdigit():
        sel = fds.filter(F.col("pid") == int(selector))
    else:
        sel = fds.filter(process_text(F.col("comm"), F.col("cmdline")).contains(selector.lower()))
    return _open_logs(sel, files).select("host", "pid", "path").distinct()


def logs_of_port(listeners: DataFrame, fds: DataFrame, port: int, files: DataFrame | None = None) -> DataFrame:
    """The listener of ``port`` on each host (lowest PID wins, for a
    fixed answer) and its open log files.  Distinct ``(host, port, pid, path)``."""
    owner = listeners.filter(F.col("port") == port).groupBy("host", "port").agg(F.min("pid").alias("pid"))
    j = owner.join(fds, ["host", "pid"])
    return _open_logs(j, files).select("host", "port", "pid", "path").distinct()
