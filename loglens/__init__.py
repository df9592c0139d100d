"""loglens: log search, tail and watch analytics as Spark DataFrame plans.


* ``files``  -- ``path STRING, mtime TIMESTAMP, size BIGINT``
* ``lines``  -- ``path STRING, line_no BIGINT, line STRING`` plus a time column
  (``file_mtime`` for batch files, ``observed_at`` for streams)

Everything is a lazily built DataFrame; nothing is collected to the driver.
"""

from loglens.config import LogQuery, Options
from loglens.session import checkpoint_root, get_session

__all__ = ["LogQuery", "Options", "get_session", "checkpoint_root"]
