"""Path parts and file-name predicates (F7, P9, P10, F10) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
LOG_EXTENSIONS = (".log", ".out", ".err", ".txt")
LOG_NAMES = ("access_log", "error_log", "stdout", "stderr", "current")
# -------------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def base_name(col: Column | str) -> Column:
    """last path element (plain string functions, no regex)."""
    return F.substring_index(_c(col), "/", -1)


def dir_name(col: Column | str) -> Column:
    """directory part ('/' for a top-level file, '.' without a slash)."""
    c = _c(col)
    d = c.substr(F.lit(1), F.length(c) - F.length(base_name(c)) - 1)
    return F.when(c.contains("/"), F.when(d == "", F.lit("/")).otherwise(d)).otherwise(F.lit("."))


def extension(name: Column | str) -> Column:
    """suffix from the last dot of the name, '' without one."""
    c = _c(name)
    return F.when(c.contains("."), F.concat(F.lit("."), F.substring_index(c, ".", -1))).otherwise(F.lit(""))


def stem(name: Column | str) -> Column:
    """name without its extension."""
    c = _c(name)
    return c.substr(F.lit(1), F.length(c) - F.length(extension(c)))


def _base_no_gz(col: Column | str) -> Column:
    b = F.lower(base_name(col))
    return F.when(b.endswith(".gz"), b.substr(F.lit(1), F.length(b) - 3)).otherwise(b)


def is_log(col: Column | str) -> Column:
    """Likely log file by name (lower base name, one '.gz' stripped)."""
    b = _base_no_gz(col)
    ext = extension(b)
    return (
        ext.isin(*LOG_EXTENSIONS)
        | b.contains(".log.")
        | b.isin(*LOG_NAMES)
        | ((ext == "") & b.contains("log"))
    )


def is_rotated(col: Column | str) -> Column:
    """P10: rotated / historical log by name."""
    b = F.lower(base_name(col))
    # text between the first ".log." and the next one (or the end)
    after = F.substring_index(F.substr(b, F.instr(b, ".log.") + 5), ".log.", 1)
    return b.endswith(".gz") | (b.contains(".log.") & (after != "")) | b.contains(".log-")


def process_text(comm: Column | str, cmdline: Column | str) -> Column:
    """searchable text of a process."""
    return F.lower(F.concat(F.trim(_c(comm)), F.lit(" "), F.translate(_c(cmdline), "\u0000", " ")))


# ---- the same predicates on one name, for driver-side listings ----------------------

def likely_log(name: str) -> bool:
    """P9 for a base name."""
    b = name.lower().removesuffix(".gz")
    return b.endswith(LOG_EXTENSIONS) or ".log." in b or b in LOG_NAMES or ("." not in b and "log" in b)


def rotated(name: str) -> bool:
    """P10 for a base name."""
    b = name.lower()
    parts = b.split(".log.")
    return b.endswith(".gz") or ".log-" in b or (len(parts) > 1 and parts[1] != "")
