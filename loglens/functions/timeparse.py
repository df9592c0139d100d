"""Line timestamps (F1-F3) and relative time bounds.

``prefix_time`` mirrors the original parser: seven layouts tried in order,
each against prefixes of the (trimmed) text no longer than the layout's
width and no shorter than 15 characters.  Each layout becomes an anchored
regex that extracts the candidate token plus a length rule, then
``try_to_timestamp`` -- all JVM-side Column expressions, no UDF.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
# Whitespace trimmed by the original tool (Unicode White_Space in Latin-1 + Z*).
SPACE_CLASS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
MIN_PREFIX = 15
# (token regex, max prefix width, Spark format or None for ISO-8601 cast).
# The year-less layout is 14 characters with a one-digit hour; the prefix it
# is read from must still be 15 long, so a white space has to follow then.
LAYOUTS = (
    (r"\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})", 35, None),
    (r"\d{4}-\d{2}-\d{2} +\d{1,2}:\d{2}:\d{2}[.,]\d{3}", 23, "yyyy-MM-dd H:mm:ss.SSS"),
    (r"\d{4}-\d{2}-\d{2} +\d{1,2}:\d{2}:\d{2}", 19, "yyyy-MM-dd H:mm:ss"),
    (r"\d{4}/\d{2}/\d{2} +\d{1,2}:\d{2}:\d{2}", 19, "yyyy/MM/dd H:mm:ss"),
    (r"\d{2}/\d{2}/\d{4} +\d{1,2}:\d{2}:\d{2}", 19, "MM/dd/yyyy H:mm:ss"),
    (r"[A-Za-z]{3} +\d{2} +\d{1,2}:\d{2}:\d{2}", 15, "yyyy MMM dd H:mm:ss"),
)
JSON_TIME_KEYS = ("timestamp", "time", "ts", "@timestamp")
# -----------------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(col: Column | str) -> Column:
    """Trim leading/trailing white space as the original tool does (the
    characters of ``SPACE_CLASS``; ``btrim`` is a plain character loop)."""
    return F.btrim(_c(col), F.lit(SPACE_CHARS))


def _layout_time(s: Column, token_re: str, width: int, fmt: str | None, year: Column) -> Column:
    tok = F.regexp_extract(s, rf"^({token_re})", 1)
    ok = (tok != "") & (F.length(tok) <= width)
    if width == MIN_PREFIX:
        # a shorter token needs white space up to the 15th character
        after = F.regexp_extract(s, rf"^(?:{token_re})({SPACE_CLASS}?)", 1)
        ok = ok & ((F.length(tok) == MIN_PREFIX) | (after != ""))
    norm = F.regexp_replace(F.regexp_replace(tok, " +", " "), ",", ".")
    if fmt is None:
        parsed = F.try_to_timestamp(norm)
    elif fmt.startswith("yyyy MMM"):
        mon = F.initcap(F.lower(F.substring(norm, 1, 3)))
        text = F.concat(year.cast("string"), F.lit(" "), mon, F.substring(norm, 4, 64))
        parsed = F.try_to_timestamp(text, F.lit(fmt))
    else:
        parsed = F.try_to_timestamp(norm, F.lit(fmt))
    return F.when(ok, parsed)


def _year(year: int | Column | None) -> Column:
    if year is None:
        return F.year(F.current_timestamp())
    return year if isinstance(year, Column) else F.lit(int(year))


def prefix_time(col: Column | str, year: int | Column | None = None) -> Column:
    """timestamp at the start of the (already trimmed) text, or NULL.

    ``year`` fills the year-less syslog layout (default: the current year of
    the session clock, as the original tool does).  Deviation: a JSON time
    value with leading white space is not read.
    """
    s = _c(col)  # the layouts are anchored at its start
    y = _year(year)
    return F.coalesce(*[_layout_time(s, r, w, f, y) for r, w, f in LAYOUTS])


def json_time(col: Column | str, year: int | Column | None = None) -> Column:
    """first of the keys timestamp, time, ts, @timestamp whose string parses.

    Applies only to a trimmed line that is one JSON object.  The keys run
    through one lambda so the generated code stays small.
    """
    s = trim_space(col)
    v = F.try_parse_json(s)
    paths = [f"$.{k}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) else f"$['{k}']" for k in JSON_TIME_KEYS]
    cands = F.array(*[F.try_variant_get(v, p, "string") for p in paths])
    y = _year(year)
    parsed = F.filter(F.transform(cands, lambda x: prefix_time(x, y)), lambda t: t.isNotNull())
    obj = s.startswith("{") & s.endswith("}")
    return F.when(obj, F.try_element_at(parsed, F.lit(1)))


def line_time(col: Column | str, year: int | Column | None = None) -> Column:
    """JSON time field, else the time prefix of the trimmed line."""
    return F.coalesce(json_time(col, year), prefix_time(trim_space(col), year))


# ---- P6: relative time ---------------------------------------------------------------

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_DUR_RE = re.compile(r"([0-9]*\.?[0-9]*)(ns|us|µs|μs|ms|s|m|h)")


def _parse_duration(raw: str) -> float | None:
    s = raw
    sign = 1.0
    if s[:1] in "+-":
        sign = -1.0 if s[0] == "-" else 1.0
        s = s[1:]
    if s == "0":
        return 0.0
    if not s:
        return None
    total, pos = 0.0, 0
    while pos < len(s):
        m = _DUR_RE.match(s, pos)
        if not m or m.group(1) in ("", "."):
            return None
        total += float(m.group(1)) * _UNITS[m.group(2)]
        pos = m.end()
    return sign * total


def resolve_since(raw: str | None, now: dt.datetime) -> dt.datetime | None:
    """``30m``, ``2h``, ``7d``, ``1.5w``, ``today``, RFC 3339, date-time, date.

    ``now`` is explicit so results repeat; returns a naive datetime in the
    zone of ``now`` (the session zone), or None for no bound.
    """
    if not raw:
        return None
    if raw.lower() == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0)
    for suffix, mult in (("d", 86400.0), ("w", 7 * 86400.0)):
        if raw.endswith(suffix):
            try:
                n = float(raw[:-1])
            except ValueError:
                n = None
            if n is not None:
                return now - dt.timedelta(seconds=n * mult)
    d = _parse_duration(raw)
    if d is not None and d > 0:
        return now - dt.timedelta(seconds=d)
    try:
        t = dt.datetime.fromisoformat(raw.replace("Z", "+00:00"))
        if "T" in raw and t.tzinfo is not None:
            return t.astimezone(dt.timezone.utc).replace(tzinfo=None) if now.tzinfo is None else t
    except ValueError:
        pass
    for fmt in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(raw, fmt)
        except ValueError:
            continue
    raise ValueError(f"invalid since value {raw!r}")


def ts_literal(t: dt.datetime | str) -> Column:
    """A timestamp literal read in the session zone (no Python-side zone math)."""
    text = t if isinstance(t, str) else t.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp")
