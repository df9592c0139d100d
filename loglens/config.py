"""Options and query parameters.

``Options`` carries the defaults of the original tool's configuration; they
are fixed values that results depend on, listed together here.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# --- fixed values (defaults of the original tool) -------------------------
DEFAULT_LOG_DIRS = ("/var/log", "/opt/var/log", "/opt/log")
DEFAULT_LINES = 10            # initial lines per followed file
DEFAULT_MAX_FILES = 20        # newest files kept by discovery
HISTORY_FILE_FACTOR = 5       # cap multiplier when rotated files are included
FLUSH_INTERVAL_MS = 500
SCAN_INTERVAL_S = 5
MAX_BATCH_LINES = 10          # lines per source per flush round
MAX_BUFFER_LINES = 2000       # pending lines kept per source
RECENT = dt.timedelta(hours=24)
SEARCH_WINDOW_BYTES = 16 * 1024 * 1024
FOLLOW_READ_BYTES = 4 * 1024 * 1024
LINE_CAP_BYTES = 2 * 1024 * 1024
ALERT_RATE_WINDOW_S = 60
MAX_ALERT_GROUPS = 200
MAX_ALERT_EVENTS = 100_000
MAX_RENDERED_ALERTS = 20
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    default_log_dirs: tuple[str, ...] = DEFAULT_LOG_DIRS
    lines: int = DEFAULT_LINES
    max_files: int = DEFAULT_MAX_FILES
    flush_interval_ms: int = FLUSH_INTERVAL_MS
    scan_interval_s: int = SCAN_INTERVAL_S
    max_batch_lines: int = MAX_BATCH_LINES
    max_buffer_lines: int = MAX_BUFFER_LINES
    recent: dt.timedelta = RECENT


@dataclass(frozen=True)
class LogQuery:
    """A search: pattern, noise filters, time bound, context and dedup.

    ``pattern`` is an RE2-style regex (or a severity word, see
    ``functions.regex.severity_pattern``); ``None``/empty means every line.
    ``ignore`` patterns are always case-sensitive.
    """

    pattern: str | None = None
    ignore_case: bool = False
    ignore: tuple[str, ...] = field(default_factory=tuple)
    since: dt.datetime | None = None
    before: int = 0
    after: int = 0
    dedup: bool = False

    @property
    def has_pattern(self) -> bool:
        return bool(self.pattern)

    def with_defaults(self, now: dt.datetime, options: Options | None = None) -> "LogQuery":
        """A pattern without a time bound searches the recent past only
        (``now - options.recent``, 24 h by default)."""
        if self.has_pattern and self.since is None:
            recent = (options or Options()).recent
            return LogQuery(self.pattern, self.ignore_case, self.ignore, now - recent,
                            self.before, self.after, self.dedup)
        return self
